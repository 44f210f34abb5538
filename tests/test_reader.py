"""Decoding of files against known bytes."""

import pytest

from quire.operators.reader import BOM, decode_bytes

CASES = [
    (None, (None, None, "READER_FILE_EMPTY")),
    (b"", (None, None, "READER_FILE_EMPTY")),
    (BOM, ("utf-8-sig", "", None)),
    (BOM + "甲\r\n乙".encode(), ("utf-8-sig", "甲\n乙", None)),
    (BOM + b"\xff", (None, None, "READER_ENCODING_UNSUPPORTED")),
    ("甲\r乙".encode(), ("utf-8", "甲\n乙", None)),
    ("中国".encode("gb18030"), ("gb18030", "中国", None)),
    (b"\xff\xff", (None, None, "READER_ENCODING_UNSUPPORTED")),
]


@pytest.mark.parametrize(("raw", "want"), CASES)
def test_decode(raw, want):
    assert decode_bytes(raw) == want
