import xxhash

from trackloom.llm import order_minhash as omh
from trackloom.llm.order_minhash import edited_fingerprints, fingerprint, likeness, with_signature
from tests.llm import rows


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(*values):
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), seed)
    return signed(seed)


def xx_int(h, n):
    """xxhash64(long, int): an int is hashed as four bytes."""
    seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little", signed=True), 42)
    return signed(xxhash.xxh64_intdigest(n.to_bytes(4, "little", signed=True), seed))


def brute(text):
    words = text.encode().split()
    seen, entries = {}, []
    for i in range(len(words)):
        h = xx(words[i], words[i + 1] if i + 1 < len(words) else None) >> omh.POSITION_BITS
        occurrence = seen[h] = seen.get(h, -1) + 1
        if occurrence:
            h2 = xx_int(h, occurrence) >> omh.POSITION_BITS
        entries.append((h2 if occurrence else h, i))
    out = []
    shift = 64 - omh.BIN_BITS - omh.POSITION_BITS
    for b in sorted({h >> shift for h, _ in entries}):
        least = sorted(e for e in entries if e[0] >> shift == b)[:omh.TUPLE]
        code = 0
        for h, _ in sorted(least, key=lambda e: e[1]):
            code = xx(code, h)
        out.append(signed(((b & ((1 << omh.BIN_BITS) - 1)) << (64 - omh.BIN_BITS)) | ((code & (2**64 - 1)) >> omh.BIN_BITS)))
    return out


TEXTS = ["", " ", "one", "one two", "a b a b a b c", "x " * 50, rows.PROSE, " " + rows.GERMAN * 5, "z\ty\nx  w", rows.PROSE * 40]


def test_signature_against_brute_force(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    for r in with_signature(frame, "text", "s").collect():
        assert list(r.s) == brute(r.text), r.text


def test_order_matters_more_than_content(spark):
    words = (rows.PROSE * 3).split()
    moved = words[60:] + words[:60]
    frame = spark.createDataFrame([(" ".join(words), " ".join(words[:-2]), " ".join(moved), " ".join(sorted(words)))],
                                  "a string, b string, c string, d string")
    for c in "abcd":
        frame = with_signature(frame, c, f"s{c}")
    near, moved, mixed, same = frame.select(*[likeness("sa", f"s{c}") for c in "bcda"]).first()
    assert same == 1.0 and near > moved > mixed and near > 0.8


def test_edited_texts(spark):
    frame = rows.documents(spark)
    got = edited_fingerprints(frame).select(
        "doc_id", "n_chars", "edited_text", fingerprint("signature").alias("f"),
        likeness("signature", "next_signature").alias("near_next")).collect()
    given = [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]
    given.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    wanted = []
    for k, (i, text) in enumerate(given):
        after = given[(k + 1) % len(given)][1]
        half = len(text) // 2
        wanted.append((i, len(text), text[:len(text) - half] + after[:half]))
    assert sorted(((r.doc_id, r.n_chars, r.edited_text) for r in got), key=str) == sorted(wanted, key=str)
    by_id = {r.doc_id: r.f for r in got}
    assert by_id[1] == by_id[2] != by_id[3] and by_id[6] == by_id[7] == by_id[8] == ""
    assert edited_fingerprints(rows.empty(spark)).collect() == []
    single = spark.createDataFrame([(5, "abcd", None, None, 4)], rows.DOCUMENTS)
    assert [r.edited_text for r in edited_fingerprints(single).collect()] == ["abab"]


def test_many_tiles_and_gaps(spark):
    texts = [(k * k * 7919 % (1 << 50), f"text {k} " * (k % 9), None, None, 0) for k in range(1, 700)]
    got = {r.doc_id: r.edited_text for r in edited_fingerprints(
        spark.createDataFrame(texts, rows.DOCUMENTS).repartition(5)).collect()}
    order = sorted(((i, t) for i, t, *_ in texts), reverse=True)
    for k, (i, text) in enumerate(order):
        half = len(text) // 2
        assert got[i] == text[:len(text) - half] + order[(k + 1) % len(order)][1][:half]


def test_plan_has_no_python(spark, folder):
    from trackloom.llm.queries import QUERIES

    for name in ("op3_order_minhash", "op7_pareto_mix"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
