"""Decoding of files with a decoder that is handed in: pages, and a row with the reason for what can't be read."""

from docengine.operators import pages


def decoder(content):
    if content.startswith(b"locked"):
        raise ValueError("encrypted_file")
    if not content.startswith(b"%PDF"):
        raise RuntimeError("no header at byte 0")
    for n, text in enumerate(content[4:].decode().split("\f"), 1):
        if text == "broken":
            raise RuntimeError("page tree")
        yield n, text


def test_decode(spark):
    decode = lambda content: decoder(content)
    files = {"two": b"%PDFone\ftwo", "none": b"", "null": None, "locked": b"locked x", "junk": b"\x00\x01", "half": b"%PDFone\fbroken"}
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module
    rows = sorted((r.path, r.page_number or 0, r.text, r.error) for r in pages.decode(df, decode).collect())
    # A file that breaks off on its second page gives no page at all, so no half document goes on.
    assert rows == [
        ("half", 0, None, "corrupt_file"), ("junk", 0, None, "corrupt_file"), ("locked", 0, None, "encrypted_file"),
        ("none", 0, None, "empty_file"), ("null", 0, None, "empty_file"), ("two", 1, "one", None), ("two", 2, "two", None),
    ]
    assert pages.decode(df.limit(0), decode).count() == 0
