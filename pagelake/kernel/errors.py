"""Errors of a document."""

from __future__ import annotations

MISSING_HEADER = "the file doesn't begin with a PDF header"
MISSING_STARTXREF = "no startxref near the end of the file"
MALFORMED_STARTXREF = "startxref isn't followed by a number"
OOB_XREF = "a cross-reference offset lies outside the file"
MEMORY_LIMIT = "the limit of bytes is reached"
DEPTH_LIMIT = "the limit of nesting is reached"
TODO = "this feature of the format isn't supported"
VALUE_MISMATCH = "the value is of another kind"
OBJECT_NOT_FOUND = "no section has this object number"
ID_MISMATCH = "the object at the offset has another number"
NOT_A_STREAM = "the object isn't a stream"
BAD_LENGTH = "the stream's length is wrong or not given"
NESTED_OBJSTM = "an object stream can't hold another"
BAD_OBJSTM = "the object stream's numbers or offsets are wrong"
BAD_XREF_STREAM = "the cross-reference stream can't be read"
ILLEGAL_TOKEN = "bytes that begin no token"
UNEXPECTED_TOKEN = "a token that can't stand here"
PREV_LOOP = "the chain of revisions is a loop"
PREV_TOO_LONG = "the chain of revisions is too long"
EXPECTED_XREF = "no xref keyword where a table should begin"
BAD_SUBSECTION = "a table's section or record is wrong"
BAD_HEADER = "an object doesn't begin with its number"
UNEXPECTED_EOF = "the data ends too early"


class PdfError(Exception):
    def __init__(self, text: str, at: int | None = None):
        super().__init__(text)
        self.text, self.at = text, at
