"""Schemas of the relational form of documents; the one place where they are written down."""

from __future__ import annotations

VALUE = "value_kind string, value_bool boolean, value_int long, value_real double, value_text binary, value_ref_num long, value_ref_gen int, value_off long, value_len long, value_stm long"

SCHEMAS = {
    "revision": "path string, rev int, xref_offset long, trailer_offset long, classic boolean, first_section int, root_num long, root_gen int, info_num long, info_gen int, size long, error string, error_off long",
    "xref_section": "path string, sec int, rev int, first_obj long, cnt long, file_off long, row_first long, is_stream boolean, length long, w array<int>, flate boolean, predictor int, columns int, colors int, bits int",
    "xref_entry": "path string, sec int, rev int, num long, kind string, file_offset long, gen int, stm long, idx long, error string",
    "object": f"path string, num long, gen int, stm long, kind string, off long, len long, {VALUE}, error string",
    "entry": f"path string, num long, parent string, pos int, key binary, {VALUE}",
    "stream": "path string, num long, payload_off long, enc_len long, filter string, raw binary, error string",
    "decoded": "path string, num long, data binary, error string",
    "token": "path string, ord int, off long, tok string, lit binary",
    "page": "path string, page int, num long",
    "page_text": "path string, page int, text binary, text_win1252 string, error string",
    "object_range": "path string, start long, end long, label string",
}
