"""Brute force that several tests share."""


def brute_left(rows):
    """doc_id to the text left when 50-byte strings of smaller ids are cut, cut characters dropped."""
    first = {}
    for doc, text in rows:
        b = text.encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(doc, first.get(b[i : i + 50], doc))
    out = {}
    for doc, text in rows:
        b = text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < doc:
                gone[i : i + 50] = b"\1" * 50
        out[doc] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out
