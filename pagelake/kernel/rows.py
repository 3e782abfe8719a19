"""Rows of each table from one document's bytes. A document that can't be opened gives one error row or none; an object that can't, a row of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

from .errors import PdfError
from .lexer import token, tokens
from .objects import NULL, Document, Limits, Value
from .text import page_text, pages


def value_columns(v: Value, stm: int | None = None) -> dict:
    ref = v.v if v.kind == "ref" else (None, None)
    return {
        "value_kind": v.kind, "value_bool": v.v if v.kind == "bool" else None, "value_int": v.v if v.kind == "int" else None,
        "value_real": v.v if v.kind == "real" else float(v.v) if v.kind == "int" else None, "value_text": v.v if v.kind in ("string", "hexstring", "name") else None,
        "value_ref_num": ref[0], "value_ref_gen": ref[1], "value_off": v.off, "value_len": v.end - v.off, "value_stm": stm,
    }


def revision(path: str, data: bytes, limits: Limits) -> Iterator[dict]:
    try:
        doc = Document(data, limits)
    except PdfError as e:
        yield {"path": path, "rev": 0, "error": e.text, "error_off": e.at}
        return
    for k, r in enumerate(doc.revisions):
        root, info, size = (r.trailer.get(x) for x in (b"Root", b"Info", b"Size"))
        refs = {f"{n}_{p}": v.v[i] if v.kind == "ref" else None for n, v in (("root", root), ("info", info)) for i, p in enumerate(("num", "gen"))}
        yield {"path": path, "rev": k, "xref_offset": r.xref_off, "trailer_offset": r.trailer_off, "classic": r.classic, "first_section": r.first_section, **refs, "size": size.int()}


def xref_section(path: str, doc: Document) -> Iterator[dict]:
    for k, s in enumerate(doc.sections):
        c = s.codec
        yield {"path": path, "sec": k, "rev": s.rev, "first_obj": s.first, "cnt": s.count, "file_off": s.off, "row_first": s.row_first, "is_stream": s.stream, "length": s.length, "w": c.w or None, "flate": c.flate, "predictor": c.predictor, "columns": c.columns, "colors": c.colors, "bits": c.bits}


def xref_entry(path: str, doc: Document) -> Iterator[dict]:
    for k, s in enumerate(doc.sections):
        try:
            for e in doc.entries(s):
                yield {"path": path, "sec": k, "rev": s.rev, "num": e.num, "kind": e.kind, "file_offset": e.off, "gen": e.gen, "stm": e.stm, "idx": e.idx}
        except PdfError as e:
            yield {"path": path, "sec": k, "rev": s.rev, "error": e.text}


def live(doc: Document) -> Iterator[tuple]:
    """Each number's newest record that isn't free, with the object's value or the error it gives."""
    seen: set[int] = set()
    for s in doc.sections:
        try:
            records = list(doc.entries(s))
        except PdfError:
            continue
        for e in records:
            if e.num in seen:
                continue
            seen.add(e.num)
            if e.kind == "free":
                continue
            try:
                yield e, doc.at(e), None
            except PdfError as x:
                yield e, NULL, x.text


def object_(path: str, doc: Document) -> Iterator[dict]:
    for e, v, error in live(doc):
        yield {"path": path, "num": e.num, "gen": e.gen or 0, "stm": e.stm, "kind": "error" if error else v.kind, "off": v.off, "len": v.end - v.off, **value_columns(v, e.stm), "error": error}


def entry(path: str, doc: Document) -> Iterator[dict]:
    """Dictionary pairs and array elements, parents before children; ``parent`` is the path of places from the object's value."""
    for e, v, _ in live(doc):
        todo = [(v, "")]
        while todo:
            at, parent = todo.pop()
            items = at.v if at.kind in ("dict", "stream") else [(None, x) for x in at.v] if at.kind == "array" else []
            for pos, (key, x) in enumerate(items):
                yield {"path": path, "num": e.num, "parent": parent, "pos": pos, "key": key, **value_columns(x, e.stm)}
            todo += [(x, f"{parent}/{pos}" if parent else str(pos)) for pos, (_, x) in enumerate(items) if x.kind in ("dict", "array")][::-1]


def stream(path: str, doc: Document) -> Iterator[dict]:
    for e, v, _ in live(doc):
        if v.kind != "stream":
            continue
        try:
            at, n, codec = doc.payload(v)
            yield {"path": path, "num": e.num, "payload_off": at, "enc_len": n, "filter": "FlateDecode" if codec.flate else None, "raw": doc.data[at : at + n]}
        except PdfError as x:
            yield {"path": path, "num": e.num, "error": x.text}


def decoded(path: str, doc: Document) -> Iterator[dict]:
    for e, v, _ in live(doc):
        if v.kind != "stream":
            continue
        try:
            yield {"path": path, "num": e.num, "data": doc.stream(v)}
        except PdfError as x:
            yield {"path": path, "num": e.num, "error": x.text}


def token_(path: str, data: bytes, limits: Limits, off: int = 0, limit: int | None = None) -> Iterator[dict]:
    for k, t in enumerate(tokens(data, off, limit, limits.literal)):
        yield {"path": path, "ord": k, "off": t.pos, "tok": t.kind, "lit": t.literal}


def page(path: str, doc: Document) -> Iterator[dict]:
    for k, (num, _) in enumerate(pages(doc)):
        yield {"path": path, "page": k + 1, "num": num}


def page_text_(path: str, doc: Document, page: int | None = None) -> Iterator[dict]:
    for k, (_, p) in enumerate(pages(doc)):
        if page is not None and k + 1 != page:
            continue
        try:
            text = page_text(doc, p)
            yield {"path": path, "page": k + 1, "text": text, "text_win1252": text.decode("cp1252", "replace")}
        except PdfError as x:
            yield {"path": path, "page": k + 1, "error": x.text}


def object_range(path: str, doc: Document) -> Iterator[dict]:
    """Byte ranges of the header, objects, tables and trailers, for a map of the file."""
    data = doc.data
    head = data.find(b"\n") + 1
    if data[head : head + 1] == b"%":  # the mark of a binary file
        head = data.find(b"\n", head) + 1
    yield {"path": path, "start": 0, "end": head, "label": "header"}
    for s in doc.sections:
        for e in doc.entries(s):
            if e.kind == "normal":
                try:
                    yield {"path": path, "start": e.off, "end": doc.object_end(e.off), "label": f"object {e.num}"}
                except PdfError:
                    continue
    for r in doc.revisions:
        if r.classic:
            t = data.rfind(b"trailer", 0, r.trailer_off)
            yield {"path": path, "start": r.xref_off, "end": t, "label": "xref"}
            end = token(data, r.trailer.end)
            n = token(data, end.end)
            yield {"path": path, "start": t, "end": n.end if end.kind == "startxref" else r.trailer.end, "label": "trailer"}


OPENED: dict[str, Callable] = {"xref_section": xref_section, "xref_entry": xref_entry, "object": object_, "entry": entry, "stream": stream, "decoded": decoded, "page": page, "page_text": page_text_, "object_range": object_range}


def rows(table: str, limits: Limits, **options) -> Callable[[str, bytes], Iterator[dict]]:
    if table == "revision":
        return partial(_plain, revision, limits)
    if table == "token":
        return partial(_plain, partial(token_, **options), limits)

    def opened(path: str, data: bytes) -> Iterator[dict]:
        try:
            yield from OPENED[table](path, Document(data, limits), **options)
        except PdfError:
            return

    return opened


def _plain(f, limits, path, data):
    return f(path, data, limits)
