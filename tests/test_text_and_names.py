"""Text functions, club spellings and matching across sources."""

import difflib
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from movelens.functions import text as tx
from movelens.functions.numeric import feature_label, interp, money_label, ordinal, safe_round
from movelens.operators import resolve as rs


def column(spark, values, expr):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in d.orderBy("i").select(expr(F.col("s"))).collect()]


def test_fee_texts(spark):
    cases = {
        "loan transfer": "loan", "End of loan": "loan", 'Loan fee:<br /><i class="x">€5.90m</i>': "loan", "free transfer": "free",
        "Free Transfer": "free", "€85.00m": "paid", "€250k": "paid", "EUR5m": "paid", "-": "unknown", "?": "unknown", "": "unknown", None: "unknown",
    }
    assert column(spark, list(cases), tx.classify_fee) == list(cases.values())


def test_ids_in_paths(spark):
    paths = ["/dortmund/transfers/verein/16/saison_id/2022", None, "", "/without-club"]
    assert column(spark, paths, tx.id_from_path) == [16, None, None, None]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x24F), max_size=12), min_size=1, max_size=30))
def test_fold_follows_unicode(spark, texts):
    want = ["".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower() for s in texts]
    assert column(spark, texts, tx.fold) == want


def test_norm_name(spark):
    names = ["Ødegaard", "FC København", "Straße", "Þór", "Łódź", "Saint-Germain", "Nott'm Forest", "  A  B "]
    assert column(spark, names, tx.norm_name) == [
        "odegaard", "fc kobenhavn", "strasse", "or", "lodz", "saint germain", "nott m forest", "a b"
    ]


def test_search_is_literal(spark):
    assert column(spark, ["Dembélé", "a.b", "axb", None], lambda c: tx.has_text(c, "dembele")) == [True, False, False, False]
    assert column(spark, ["a.b", "axb"], lambda c: tx.has_text(c, "a.b")) == [True, False]


PAIRS_SAME = [
    ("Arsenal", "Arsenal FC"), ("Man City", "Manchester City"), ("Fenerbahçe", "Fenerbahce"), ("1.FC Köln", "Köln"),
    ("PSG", "Paris SG"), ("FC Barcelona", "Barcelona"), ("Atlético", "Atlético de Madrid"),
]
PAIRS_APART = [
    ("Arsenal", "Arsenal Tula"), ("Benfica", "Benfica B"), ("Atalanta", "Atlanta"), ("Metalist", "Metalist 1925"),
    ("Racing", "Racing Club"), ("SC Dnipro-1", "Dnipro"), ("Man City", "Man Utd"), ("Barcelona", "RCD Espanyol Barcelona"),
]


def test_club_spellings(spark):
    names = [n for p in PAIRS_SAME + PAIRS_APART for n in p]
    keys = dict(zip(names, column(spark, names, tx.club_key)))
    assert all(keys[a] == keys[b] for a, b in PAIRS_SAME)
    assert all(keys[a] != keys[b] for a, b in PAIRS_APART)


def test_canonical_is_the_longest(spark):
    d = spark.createDataFrame([("Arsenal",)] * 5 + [("Arsenal FC",), ("Lone FC",)], "n string")
    assert {r.name: r.canonical for r in rs.build_aliases(d, "n").collect()} == {"Arsenal": "Arsenal FC", "Arsenal FC": "Arsenal FC"}
    fixed = rs.canonicalise(d, ["n"], rs.build_aliases(d, "n"))
    assert {r.n for r in fixed.collect()} == {"Arsenal FC", "Lone FC"}


def test_ambiguous_words(spark):
    clubs = spark.createDataFrame(
        [(1, "Real Madrid", "ES1"), (2, "Real Betis", "ES1"), (2, "Real Betis Balompié", "ES1"), (3, "Torpedo Moskva", "RU1"), (4, "Dinamo Moscow", "RU1")],
        "club_id int, name string, league string",
    )
    got = {(r.league, r.word) for r in rs.ambiguous_words(clubs, "league", "club_id", tx.norm_name(F.col("name"))).collect()}
    assert got == {("ES1", "real"), ("RU1", "moscow")}


def test_club_match_tiers(spark):
    pairs = spark.createDataFrame(
        [
            ("GB1", "man city", "manchester city"), ("ES1", "barcelona", "fc barcelona"), ("L1", "bayern munich", "bayern munchen"),
            ("ES1", "real madrid", "real betis"), ("RU1", "lokomotiv", "lokomotif"), ("GB1", "west ham", "leeds united"),
        ],
        "league string, a string, b string",
    )
    ambiguous = spark.createDataFrame([("ES1", "real")], "league string, word string")
    got = {(r.a, r.b) for r in rs.club_matches(pairs, ambiguous, rs.alias_table(spark)).collect()}
    assert got == {("man city", "manchester city"), ("barcelona", "fc barcelona"), ("bayern munich", "bayern munchen"), ("lokomotiv", "lokomotif")}


def brute_close(queries, names):
    out = set()
    for q in queries:
        found = []
        for n in names:
            a, b = set(q.split()), set(n.split())
            ratio = difflib.SequenceMatcher(None, n, q).ratio()
            if (a <= b or b <= a) and ratio >= 0.6:
                found.append((ratio, n))
        out |= {(q, n) for _, n in sorted(found, reverse=True)[:3]}
    return out


def test_blocked_names_equal_all_pairs(spark):
    parts = ["silva", "bremer", "alisson", "becker", "kerim", "frei", "koyunlu", "gleison", "toure", "ballo", "mario", "suarez"]
    names = [f"{a} {b}" for i, a in enumerate(parts) for b in parts[i + 1 : i + 4]] + ["kerim frei koyunlu", "fode ballo toure", "silva"]
    queries = ["bremer", "alisson", "kerim frei", "fode ballo", "mario zarate", "silva", "gleison bremer toure", "suarez mario x"]
    q = spark.createDataFrame([("L", 1, n) for n in queries], "league string, season int, name string")
    n = spark.createDataFrame([("L", 1, x) for x in names] + [("M", 1, "bremer one")], "league string, season int, name string")
    got = {(r.name, r.found) for r in rs.close_names(q, n, ["league", "season"]).collect()}
    assert got == brute_close(queries, names)


def test_resolution_precedence(spark):
    board = spark.createDataFrame(
        [
            ("L", 2019, 1, "Marc Stegen", "Alpha"), ("L", 2020, 2, "Marc Steger", "Alpha"),   # exact but older beats similar but newer
            ("L", 2020, 3, "Gleison Bremer", "Beta"),                                          # only a similar name
            ("L", 2020, 4, "Mamadou Sakho", "Gamma"), ("L", 2020, 5, "Sakho", "Alpha"),        # exact elsewhere rules similar out
            ("L", 2019, 6, "Twin Name", "Alpha"), ("L", 2020, 7, "Twin Name", "Alpha"),        # newest season first
        ],
        "league string, season int, provider_id long, provider_name string, team string",
    )
    ask = [(1, "Marc Stegen", "Alpha"), (2, "Bremer Gleison", "Beta FC"), (3, "Mamadou Sakho", "Alpha"), (4, "Twin Name", "FC Alpha"), (5, "Nobody", "Alpha")]
    lookups = spark.createDataFrame([(k, "L", s, n, c) for k, n, c in ask for s in (2019, 2020)], "id int, league string, season int, name string, club string")
    clubs = spark.createDataFrame([(1, "Alpha", "L"), (2, "Beta", "L"), (3, "Gamma", "L")], "club_id int, name string, league string")
    got = {r.id: (r.provider_id, r.how) for r in rs.resolve(lookups, board, clubs, ["id"]).collect()}
    assert got[1] == (1, "exact") and got[4] == (7, "exact") and 3 not in got and 5 not in got
    assert rs.shared_ids(spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 3)], "i int, s int"), "i", "s").collect()[0][0] == 1


def test_numbers(spark):
    one = spark.range(1)
    got = one.select([
        safe_round(F.lit(200.0), -3), safe_round(F.lit(0.0), -3), safe_round(F.lit(None).cast("double"), -3), safe_round(F.lit(50000.0), -3)
    ]).first()
    assert got[0] > 0 and got[1] == 0 and got[2] is None and got[3] == 50000
    assert list(one.select(*[money_label(F.lit(v)) for v in (3e5, 5e7, 2.049e9, 0.0)]).first()) == ["€0.3m", "€50m", "€2.05b", "free"]
    assert list(one.select(*[ordinal(F.lit(float(v))) for v in (1, 2, 3, 4, 11, 112, 21)]).first()) == ["1st", "2nd", "3rd", "4th", "11th", "112th", "21st"]
    assert one.select(feature_label("log_transfer_fee", F.lit(0.0))).first()[0] == "free"


@pytest.mark.parametrize("points", [[0, 1, 1, 2, 5], [3, 3, 3], [0, 1, 2]])
def test_interpolation_like_numpy(spark, points):
    import numpy as np

    xs = [-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 9.0]
    d = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("p", F.array(*[F.lit(float(p)) for p in points]))
    got = [r[0] for r in d.orderBy("x").select(interp(F.col("x"), F.col("p"))).collect()]
    assert np.allclose(got, np.interp(xs, points, range(len(points))))


def test_labels_round_exact_halves_to_even(spark):
    from movelens.functions.numeric import fixed_text, money_label

    amounts = [float(x) for x in (50_000 * i for i in range(0, 1400))] + [999_999.0, 1e9, 1_005_000_000.0, 2_345_678_901.0, -350_000.0, -2_500_000.0]
    df = spark.createDataFrame([(x,) for x in amounts], "x double")

    def expected(x):
        m = x / 1_000_000
        if x == 0:
            return "free"
        if abs(x) >= 1_000_000_000:
            return f"€{x / 1_000_000_000:.2f}b"
        return f"€{m:.1f}m" if m < 1 else f"€{m:.0f}m"

    assert {r.x: r.t for r in df.select("x", money_label(F.col("x")).alias("t")).collect()} == {x: expected(x) for x in amounts}
    values = [0.125, 0.375, 2.675, 1.005, 0.5, 1.5, 2.5, -0.5, 12.345, 1e-9, 0.285]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed_text(F.col("v"), 2).alias("t"), fixed_text(F.col("v"), 0, "%s cm", "+").alias("s")).collect()
    assert [(r.t, r.s) for r in got] == [(f"{r.v:.2f}", f"{r.v:+.0f} cm") for r in got]


def test_search_finds_what_is_in_the_text(spark):
    from movelens.functions.text import has_text

    names = ["한국 FC", "\U0001d400\U0001d401 club", "São Paulo", "Œuvre", "Straße"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for term, found in (("한국", "한국 FC"), ("\U0001d400", "\U0001d400\U0001d401 club"), ("sao", "São Paulo"), ("SÃO", "São Paulo")):
        assert [r.n for r in df.filter(has_text(F.col("n"), term)).collect()] == [found]
