import re

from pyspark.sql import functions as F

from trackloom.llm import pii, secret_scan
from tests.llm import rows

PERSONAL = [
    (101, "mail a.b@c.de, b_c@d-e.fr.x and @x.de or a@b; a@b.c_d@e.f +49 (30) 123-4567.", "en", "a", 1),
    (102, "ip 1.2.3.4 and 1.2.3.4.5.6.7.8 or 300.1.1.1 or 0001.2.3.255, 1.2.3 " + "9" * 30_000, "en", "a", 1),
    (103, "card 4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112, +1 23 +123456789012345678", "en", "a", 1),
    (104, "+1" + "(" * 20_000 + "2 a" + "@b" * 20_000 + " x" + "a" * 50_000, "en", "a", 1),
    (105, "ünï 4111111111111111 ünï +4930123456789", "en", "a", 1)]
SECRET = [
    (201, 'Password = "abcdefghijkl" pwd passwd:short TOKEN=abc/def+ghi=jkl api_key: \'0123456789ab\'', "en", "a", 1),
    (202, "AKIAABCDEFGHIJKLMN AKIASHORT deadbeefdeadbeef deadbeef secret'='deadbeefdeadbeef0", "en", "a", 1),
    (203, "key q8Zx0LmP3vR7tY2wK5nB1cJ4 and the_ordinary_name_of_a_thing plainlongwordofletters", "en", "a", 1),
    (204, "ſecret=abcdefghijklmn toKen=abcdefghijklmn", "en", "a", 1)]


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        value = int(c) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def plain_personal(text):
    only = (lambda s: re.sub("[^0-9]", "", s))
    found = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
              if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
              if 13 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    return found + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                    if 9 <= len(only(m[0])) <= 15]


def test_personal_data(spark):
    frame = rows.documents(spark, PERSONAL)
    texts = sorted((r.doc_id or 0, r.text or "") for r in frame.select("doc_id", "text").collect())
    got = pii.find_personal_data(frame).collect()
    assert len(got) == len(texts)
    by_id = {r.doc_id: [tuple(s) for s in r.spans] for r in got}
    for i, text in texts:
        if i and i not in (14, 15) and len(text) < 20_000:
            assert [s[:3] for s in by_id[i] if s[3]] == plain_personal(text)
    for k in (1, 4, 6, 7, 11, 12):
        assert by_id[k] == []
    assert [s[0] for s in by_id[104]] == [] or len(by_id[104]) < 5
    assert pii.find_personal_data(rows.empty(spark)).collect() == []


def test_skip_edges_carry_labels():
    unary = [[0.0] * 5 for _ in range(pii.FEATURES)]
    import numpy as np

    unary = np.array(unary)
    unary[1, 1] = 4.0  # an @ speaks for an email
    skip = np.eye(5) * 6
    model = pii.SkipChain(unary, np.zeros((5, 5)), skip)
    graph = pii.Graph(["bob77@x far away words bob77"])
    assert graph.skip and model.marginals(graph).argmax(1).tolist() == [1, 1]
    assert pii.SkipChain(unary, np.zeros((5, 5)), 0 * skip).marginals(graph)[1].max() < 0.5


def test_messages_on_a_tree_are_exact():
    import itertools

    import numpy as np

    dice = np.random.default_rng(1)
    model = pii.SkipChain(dice.normal(size=(pii.FEATURES, 5)), dice.normal(size=(5, 5)), dice.normal(size=(5, 5)))
    graph = pii.Graph(["1a 2b 3c"])
    local = graph.x @ model.unary
    weight = np.zeros((3, 5))
    for y in itertools.product(range(5), repeat=3):
        score = np.exp(sum(local[k, y[k]] for k in range(3)) + model.chain[y[0], y[1]] + model.chain[y[1], y[2]])
        for k in range(3):
            weight[k, y[k]] += score
    rounds, pii.ROUNDS = pii.ROUNDS, 60
    try:
        assert np.allclose(model.marginals(graph), weight / weight.sum(1, keepdims=True), atol=1e-6)
    finally:
        pii.ROUNDS = rounds


def test_one_clear_mention_reaches_all_others():
    import numpy as np

    unary = np.zeros((pii.FEATURES, 5))
    unary[1, 1] = 4.0  # an @ speaks for an email
    model = pii.SkipChain(unary, np.zeros((5, 5)), np.eye(5) * 6)
    for text in ("bob77@x" + " and then bob77" * 40, "bob77 and then " * 40 + "bob77@x"):
        assert (model.marginals(pii.Graph(["5 other", text]))[1:, 1] > 0.5).all()
    # Evidence passes along neighbours as far as the potentials carry it.
    far = pii.SkipChain(unary, np.eye(5) * 12, np.zeros((5, 5))).marginals(
        pii.Graph(["bob77@x " + " ".join(f"{k}z" for k in range(30))]))
    assert (far[:, 1] > 0.5).all()


def test_edges_grow_with_the_text_only():
    graph = pii.Graph(["a1 b " * 3000])
    assert len(graph.text) == len(graph.skip) == 3000 and graph.hubs == 1


def plain_secrets(text):
    found = [("assign", m.start(), m.end()) for m in re.finditer(
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secrets(spark, folder):
    frame = rows.documents(spark, SECRET)
    model = secret_scan.secret_model(spark.read.parquet(f"{folder}/documents.parquet"))
    got = secret_scan.find_secrets(frame, model, keep=("doc_id", "text")).collect()
    assert secret_scan.find_secrets(frame).count() == len(got)
    assert len(got) == frame.count()
    for r in got:
        assert [tuple(s)[:3] for s in r.spans if s.base] == plain_secrets(r.text or "")
    random = {r.doc_id: [r.text[s.start:s.end] for s in r.spans if not s.base] for r in got}
    assert random[203] == ["q8Zx0LmP3vR7tY2wK5nB1cJ4"] and not random[1] and not random[4]
    assert secret_scan.find_secrets(rows.empty(spark)).collect() == []


def test_models_tell_held_out_strings_apart(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = secret_scan.secret_model(docs.filter("doc_id % 2 = 0"))
    import numpy as np

    dice = np.random.default_rng(9)
    drawn = ["".join(dice.choice(list(secret_scan.ALPHABET[:62]), 24)) for _ in range(200)]
    words = [w for r in docs.filter("doc_id % 2 = 1").collect() for w in re.findall("[A-Za-z]{12,}", r.text)]
    assert np.mean([model.ratio(s) >= secret_scan.RATIO for s in drawn]) > 0.98
    assert np.mean([model.ratio(w) >= secret_scan.RATIO for w in words]) < 0.01


def test_redaction(spark):
    frame = spark.createDataFrame([("ab secret cd", [("x", 3, 9, True), ("y", 5, 8, True)]), ("é1é", [("x", 1, 2, True)]),
                                   ("keep", []), (None, [])], f"text string, spans {secret_scan.SPAN}")
    got = [r[0] for r in frame.select(secret_scan.redacted(F.col("text"), F.col("spans"))).collect()]
    assert got == ["ab [SECRET] cd", "é[SECRET]é", "keep", None]
