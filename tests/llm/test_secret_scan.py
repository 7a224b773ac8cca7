import hashlib
import random
import re

from movelens.llm import secret_scan as ss

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    t = text or ""
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 24]
    spans.sort(key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
    return spans


def texts():
    rng = random.Random(4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    upper = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["th", "er", "ing", "onst", "re", "nde", "ation"]) for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    out = [
        None, "", "token=token:abcdefgh", "token=ab secret = 'abcdef' PassWord: \"x.y/z+1=\" api_key=12345 apikey:123456", "AKIA" + "A" * 15, "xAKIA" + "A" * 16 + "b",
        "AKIAAKIA" + "B" * 20, "é" * 30 + "token==abcdef", "secret:\x20\x20\x20zzzzzz\n" * 50, "0" * 24 + "g" + "1" * 23, "passwd\"='abcdef passwd=\tabcdefg",
        "toKen=abcdefg ſecret=abcdefg", "a" * 5000 + "token=" + "b" * 5000, "\U0001f600token=abcdef \U0001f600" + hexes(30),
    ]
    for _ in range(150):
        out.append(prose(40) + rng.choice([f" token = \"{hexes(40)}\" ", f" password={hexes(18)} ", f" AKIA{upper(16)} ", f" {hexes(32)} ", " "]) + prose(30))
    return out


def test_base_spans_equal_python(spark):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(3, "again token=abcdef", 1), (None, "token=abcdef", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(3)
    got = ss.scan_report(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    expected = []
    for k, t, _ in rows:
        b = base(t)
        count = [sum(s[0] == kind for s in b) for kind in ("assign", "access", "hex")]
        expected.append((k, *count, hashlib.sha256(",".join(f"{a}:{s}:{e}" for a, s, e in b).encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(expected, key=repr)
    for r in got:
        listed = [s for s in r.spans.split(",") if s and not s.startswith("markov")]
        assert len(listed) == r.n_assign + r.n_access + r.n_hex
    assert ss.scan_report(df.limit(0), "doc_id", "text").count() == 0


def corpus():
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    kinds = [(16, letters + "0123456789"), (19, letters + "0123456789"), (32, letters), (40, letters[26:]), (24, "0123456789abcdef-")]
    strings = ["".join(rng.choice(chars) for _ in range(n)) for n, chars in kinds for _ in range(12)]
    names = ["thingation_and_thering_2", "onstruction-number-10", "the-ingredients-of-list-7", "Constructionationing", "ingredientsandthings"] * 3
    rows = [(i, f"é thing {s} ation") for i, s in enumerate(strings)] + [(100 + i, f"the {s} ere") for i, s in enumerate(names)]
    part = ["th", "er", "ing", "onst", "re", "nde", "ation", "Th", "En", "les", "ou", "ai", "que", "ch", "ei", "ver"]
    word = lambda: "".join(rng.choice(part) for _ in range(rng.randrange(1, 9)))
    train = [(9000 + i, " ".join(word() for _ in range(120))) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(texts() * 3)] + [(5000 + i, "the-ingredients-of-thering onstruction_and_nde1 thering-of-number-12 Thereingationing " * 3) for i in range(150)]
    return strings, names, rows + train


def test_markov_finds_random_strings_only(spark):
    strings, names, rows = corpus()
    got = {r.doc_id: r for r in ss.scan_report(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    found = [got[i].spans == f"markov:8:{8 + len(s)}" or (got[i].n_hex == 1) for i, s in enumerate(strings)]
    assert sum(found) >= 0.9 * len(strings), [s for s, f in zip(strings, found) if not f]
    assert all(any(found[k * 12:(k + 1) * 12]) for k in range(5))
    assert sum(got[100 + i].n_markov for i in range(len(names))) == 0


def test_markov_spans_equal_plain_python(spark):
    """Every token's ratio recomputed from the learned weights, and every span that passes."""
    _, _, rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    judge = ss.learn(df, "text")
    assert judge.least_mean is not None
    size = len(ss.ALPHABET)

    def ratio(s):
        return sum(judge.weights[ss.ALPHABET.index(a) * size + ss.ALPHABET.index(b)] for a, b in zip(s, s[1:]))

    got = {r.doc_id: r.spans for r in ss.scan(df, "text").collect()}
    n = 0
    for k, t in rows:
        taken = base(t)
        expected = []
        for m in re.finditer(ss.TOKEN, t or ""):
            r = ratio(m.group())
            if r > judge.least_sum and r >= judge.least_mean * (len(m.group()) - 1) and not any(a < m.end() and m.start() < b for _, a, b in taken):
                expected.append((m.start(), m.end(), round(r, 6)))
        assert [(x.s, x.e, round(x.ratio, 6)) for x in got[k] if x.kind == "markov"] == expected
        n += len(expected)
    assert n > 40


def test_learned_counts_equal_plain_python(spark):
    _, _, rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = ss._found(df, "text").collect()
    words = sorted(w for r in found for w in r.words)
    assert words == sorted(w for _, t in rows if not base(t) for w in re.findall(ss.TOKEN, t or ""))
    pairs = {}
    for w in words:
        for a, b in zip(w, w[1:]):
            pairs[a + b] = pairs.get(a + b, 0) + 1
    assert ss._pair_counts(spark.createDataFrame([(w,) for w in words], "s string")) == pairs


def test_nothing_learned_adds_nothing(spark):
    df = spark.createDataFrame([(1, "aB3xZ9qLmN7pR2tV plain words of text"), (2, None)], "doc_id long, text string")
    assert [r.spans for r in ss.scan_report(df, "doc_id", "text").collect()] == ["", ""]


def test_redaction(spark):
    rows = [(1, "a token=abcdef1 b"), (2, None), (3, "token=\"" + "0a" * 20 + "\" end")]
    df = spark.createDataFrame([(k, t, ["x"], ["w"], "s", [1]) for k, t in rows], "doc_id long, text string, hex array<string>, words array<string>, spans string, assign array<int>")
    got = ss.redact(df, "text")
    assert got.columns == df.columns
    assert {r.doc_id: (r.text, r.hex, r.words, r.spans, r.assign) for r in got.collect()} == {
        k: (t, ["x"], ["w"], "s", [1]) for k, t in ((1, "a [secret] b"), (2, None), (3, "[secret]\" end"))}
    assert ss.redact(df.limit(0), "text").count() == 0
    assert set(ss.scan(df, "text").columns) == set(df.columns) - {"text"}
