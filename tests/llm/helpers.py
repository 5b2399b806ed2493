"""Small inputs and brute-force counterparts."""

import re
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves.
CLASHING = "_id _k _kept _hid _hth _hits _file _run _row row run path _shard _source _copies _lang _th _th0 _piece _metadata shard tier".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, rows):
    """Documents of (doc_id, text[, lang, source]) with extra columns whose names clash with the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name in ("score", "block", "cid", "_h", "_n", "component", "copies", "tk", "words", "key", "shard_", *CLASHING):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def held_out(doc_id, of):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % of == 1


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}
