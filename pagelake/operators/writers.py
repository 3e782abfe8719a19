"""Documents from rows: one page of words, updates of it, and compact ones of object streams."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import spread


_space = re.compile("[ \\t\\n\\r\\x0b\\f]+")


def _built(rows: DataFrame, columns: list[str], make) -> DataFrame:
    """path, content by ``make(*columns)`` of each row; ``path`` is the first column as text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b = batch.slice(at, 64)
                made = [make(*x) for x in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["path", "content"])

    return spread(rows.select(F.col(columns[0]).cast("string").alias("path"), *columns)).mapInArrow(run, "path string, content binary")


def word_page(text: str | None, compress: bool = False, updates: int = 0) -> bytes:
    """A document of one page that shows each word of a text as a text object of its own; each update writes the page again."""
    import zlib

    from ..kernel.emit import Name, Ref, Writer, string
    from ..kernel.fonts import encode

    body = b"".join(b"BT /F1 10 Tf 0 0 Td " + string(encode(w)) + b" Tj ET\n" for w in _space.split(text or "") if w)
    w = Writer()
    content = w.stream(zlib.compress(body), {"Filter": Name("FlateDecode")}) if compress else w.stream(body)
    font = w.object({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")})
    page = {"Type": Name("Page"), "Parent": Ref(4), "MediaBox": [0, 0, 612, 792], "Contents": Ref(content), "Resources": {"Font": {"F1": Ref(font)}}}
    w.object(page)
    w.object({"Type": Name("Pages"), "Kids": [Ref(3)], "Count": 1})
    root = w.object({"Type": Name("Catalog"), "Pages": Ref(4)})
    out = w.close(root)
    for k in range(updates):
        u = Writer(out)
        u.object({**page, "Rotate": 90 * (k + 1)}, 3)
        out = u.close(root)
    return out


def word_pages(rows: DataFrame, key: str = "doc_id", text: str = "text", compress: bool = False) -> DataFrame:
    return _built(rows, [key, text], lambda _, t: word_page(t, compress))


def updated_pages(rows: DataFrame, updates: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _built(rows, [key, text, updates], lambda _, t, n: word_page(t, False, n))


def compact(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Documents whose objects are in object streams under a predicted cross-reference stream; object 3 holds a number of the row."""

    def make(_, n):
        from ..kernel.emit import Name, Ref, syntax, xref_stream_document

        objects = [(1, syntax({"Type": Name("Catalog"), "Pages": Ref(2)})), (2, syntax({"Type": Name("Pages"), "Kids": [Ref(3)], "Count": 1})), (3, syntax({"Type": Name("Page"), "Parent": Ref(2), "X": n}))]
        return xref_stream_document(objects, 1)

    return _built(rows, [key, number], make)


def save(docs: DataFrame, folder: str) -> DataFrame:
    """Writes each (path, content) to a file of its own under ``folder``, a folder that all machines share; path and bytes written come back.

    The write is atomic (a rename), so a task that runs again leaves whole files.
    """

    def run(batches):
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names = [os.path.join(folder, os.path.basename(p.removesuffix(".pdf")) + ".pdf") for p in batch.column(0).to_pylist()]
            for name, data in zip(names, batch.column(1).to_pylist(), strict=True):
                part = f"{name}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, name)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64())], ["path", "bytes"])

    return docs.select("path", "content").mapInArrow(run, "path string, bytes long")
