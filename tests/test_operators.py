import datetime
import inspect
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from kappaforge.operators import adjudication, agreement, annotations, mapping, matching, notes, power, ranked, resample

ANN = "rater string, key string, kind string, pos long, code string"


def pair(spark, a, b, level="exact", kind="dx"):
    """One episode: lists of annotations (sets of codes) of two raters."""
    rows = [(r, "e", kind, i, c) for r, side in (("a", a), ("b", b)) for i, codes in enumerate(side) for c in codes]
    rows += [(r, "e", "px", 99, "Z99") for r in ("a", "b")] if kind == "dx" else []
    pairs = spark.createDataFrame([("p", "a", "b")], "pair string, rater_a string, rater_b string")
    return agreement.comparisons(spark.createDataFrame(rows, ANN), pairs, level)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ([{"H71"}, {"J35"}], [{"J35"}, {"H71"}], 1.0),
        ([{"H71"}], [], 1.0),
        ([{"H71"}], [{"J35"}], 1.0),
        ([], [], None),
    ],
)
def test_kappa_oddities(spark, a, b, want):
    assert agreement.kappa_units(pair(spark, a, b)).first().dx == want


def test_kappa_below_one(spark):
    assert agreement.kappa_units(pair(spark, [{"H71", "J35"}], [{"H71"}, {"J35"}])).first().dx < 1


def plain_kappa(a, b):
    fa, fb = set().union(*a, set()), set().union(*b, set())
    x, y = [int(bool(s & fb)) for s in a], [int(bool(s & fa)) for s in b]
    w = max(len(x), len(y))
    x, y = x + [0] * (w - len(x)), y + [0] * (w - len(y))
    if not w:
        return None
    if len({*x, *y}) == 1:
        return 1.0
    po = sum(i == j for i, j in zip(x, y)) / w
    pe = sum(x) / w * sum(y) / w + (1 - sum(x) / w) * (1 - sum(y) / w)
    return (po - pe) / (1 - pe)


def test_kappa_against_plain(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for e in range(200):
        sides = {r: [{f"C{rng.randrange(5)}" for _ in range(rng.randint(1, 2))} for _ in range(rng.randint(0, 4))] for r in "ab"}
        want[str(e)] = plain_kappa(*sides.values())
        rows += [(r, str(e), "dx", i, c) for r, s in sides.items() for i, cs in enumerate(s) for c in cs] + [(r, str(e), "px", 0, "Z") for r in "ab"]
    pairs = spark.createDataFrame([("p", "a", "b")], "pair string, rater_a string, rater_b string")
    for r in agreement.kappa_units(agreement.comparisons(spark.createDataFrame(rows, ANN), pairs, "exact")).collect():
        assert (r.dx is None and want[r.key] is None) or math.isclose(r.dx, want[r.key], abs_tol=1e-9), r


def test_averages_and_scores(spark):
    units = spark.createDataFrame([("p", "1", 1.0, None), ("p", "2", 0.5, 1.0)], "pair string, key string, dx double, px double")
    assert agreement.category_average(units).first().kappa == 0.875
    both = pair(spark, [{"H719", "J350"}], [{"H710"}], "category")
    s = {r.code_type: r for r in agreement.set_scores(both).collect()}
    assert (s["dx"].precision, s["dx"].recall) == (0.5, 1.0)
    j, m = both.select(*agreement.overlap(F.col("a"), F.col("b"), "dx")).first()
    assert (j, m) == (0.5, 1)


def test_mcnemar_and_bh(spark):
    rows = [("p", 1, 0)] * 3 + [("p", 0, 1)] * 3 + [("q", 1, 1)] * 2 + [("q", None, 1)]
    got = {r.pair: r for r in agreement.mcnemar(spark.createDataFrame(rows, "pair string, m int, c int"), "m", "c").collect()}
    assert math.isclose(got["p"].chi2, 1 / 6) and got["q"].chi2 == 0 and got["q"].n == 2
    tests = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,), (2.0,)], "p double")
    q = {r.p: r.q for r in agreement.benjamini_hochberg(tests).collect()}
    assert math.isclose(q[0.01], 0.05) and math.isclose(q[0.03], q[0.04]) and q[2.0] == 1.0
    assert math.isclose(spark.createDataFrame([(3.841458820694124,)], "x double").select(resample.chi2_tail(F.col("x"))).first()[0], 0.05, abs_tol=1e-9)


def test_cohen_kappa(spark):
    rows = [("x", "x")] * 4 + [("x", "y")] * 1 + [("y", "y")] * 3 + [("y", "x")] * 2 + [(None, "x")]
    r = agreement.cohen_kappa(spark.createDataFrame(rows, "a string, b string"), "a", "b").first()
    assert r.n == 10 and math.isclose(r.kappa, (0.7 - 0.5) / 0.5)


def test_outliers(spark):
    rows = [(r, "e", "dx", 0, c) for r, cs in (("x", ["A00"]), ("y", ["A00", "B00"]), ("z", ["A00", "B00"])) for c in cs] + [("x", "f", "dx", 0, "A00")]
    got = {r.rater: r for r in agreement.outlier_contrast(spark.createDataFrame(rows, ANN), ["x", "y", "z"]).collect()}
    assert got["x"].n_triples == 1 and got["x"].contrast == -0.5 and got["y"].contrast == 0.25


def test_cells_and_episodes(spark):
    t = spark.createDataFrame([("r", "k", 1, "H71.X n/a J35.0", "e08.1"), ("r", "k", 2, None, "E08.1"), ("r", "k", 3, "h71", None)], "rater string, key string, ord long, dx string, px string")
    long = annotations.from_cells(t, ["dx"], ["px"], ["rater", "key"])
    e = annotations.episodes(long).first()
    assert e.dx == ["H71", "J350"] and e.px == ["E081"] and len(e.dx_rows) == 2 and len(e.px_rows) == 2
    assert {(r.kind, r.code) for r in annotations.code_table(long).collect()} >= {("dx", "H71"), ("dx", "J35"), ("px", "E08"), ("combined", "E08")}


def test_coder_match(spark):
    import datetime as dt

    d = dt.date
    ep = spark.createDataFrame([(1, 10, d(2024, 3, 2)), (2, 20, d(2024, 5, 5)), (3, 30, d(2024, 5, 5)), (4, 40, None)], "ep_key int, nid int, adm date")
    coder = spark.createDataFrame([(10, 1, d(2024, 2, 3)), (10, 2, d(2024, 3, 2)), (20, 3, d(2020, 1, 1)), (30, 4, d(2020, 1, 1)), (30, 5, d(2021, 1, 1))], "nid int, seq int, adm date")
    got = {r.ep_key: (r.seq, r.how) for r in matching.match_coder(ep, coder).collect()}
    assert got == {1: (1, "date"), 2: (3, "single")}


def test_map_targets(spark):
    rows = [
        ("diagnosis", "1", 1, 1, "IFA 1", "", "H660", 0), ("diagnosis", "1", 1, 3, "TRUE", "ADDITIONAL CODE MANDATORY", "H661", 1), ("diagnosis", "1", 1, 4, "OTHERWISE TRUE", None, "H669", 2), ("diagnosis", "1", 2, 1, "", "", "Z00", 3),
        ("diagnosis", "2", 2, 1, "", "", "Z00", 4), ("procedure", "3", 1, 1, "IFA 2", "", "E081", 5), ("procedure", "3", 1, 1, "IFA 3", "", "E082", 6),
    ]
    t = mapping.targets(spark.createDataFrame(rows, "refset string, sctid string, map_group int, priority int, map_rule string, advice string, target string, ord int"))
    got = {r.sctid: (r.code, r.candidates) for r in t.collect()}
    assert got == {"1": ("H66.9", "H66.0;H66.1;H66.9"), "2": (None, ""), "3": ("E08.1", "E08.1;E08.2")}
    labels = spark.createDataFrame([("Diagnoses", "1"), ("diagnoses ", "9"), ("Procedures", "3"), ("Diagnoses", "none"), (None, "1"), ("Diagnoses", "2")], "qualifier string, snomed_ct string")
    done = [(r.qualifier, r.snomed_ct, r.icd10, r.opcs4, r.classification_candidates) for r in mapping.classified(labels, t).collect()]
    assert ("Diagnoses", "1", "H66.9", None, "H66.0;H66.1;H66.9") in done and ("Diagnoses", "2", None, None, "") in done and ("diagnoses ", "9", None, None, None) in done and ("Procedures", "3", None, "E08.1", "E08.1;E08.2") in done
    assert (None, "1", None, None, None) in done and ("Diagnoses", "none", None, None, None) in done


def test_selection(spark):
    stage1 = spark.createDataFrame([("e", 0, "Diagnoses", "otitis", "H66.9", None), ("e", 1, "Diagnoses", "polyp 0", "J33.9", None), ("e", 2, "Procedures", "FESS sinus", None, None)], "episode_id string, idx int, qualifier string, text string, icd10 string, opcs4 string")

    def run(*picks):
        rows = spark.createDataFrame([("e", *p) for p in picks], "episode_id string, category string, rank int, ref string")
        return sorted((r.idx, r.primary_secondary) for r in matching.resolve_selection(stage1, rows).collect())

    assert run(("diagnoses", 0, "0"), ("diagnoses", 1, "j33.9"), ("procedures", 0, "FESS")) == [(0, "primary"), (1, "secondary"), (2, "primary")]
    assert run(("procedures", 0, "1")) == [] and run(("diagnoses", 0, "2.7")) == []
    assert run(("diagnoses", 0, "0"), ("diagnoses", 1, "0"), ("diagnoses", 3, "1")) == [(0, "primary")]
    assert run(("procedures", 0, "none")) == [(2, "primary")] and run(("diagnoses", 0, "inf"), ("diagnoses", 1, None)) == []


def test_anchor(spark):
    import datetime as dt

    d = dt.date
    n = spark.createDataFrame([(1, d(2024, 1, 1), "ENT", "Left ear cholesteatoma found. Grommet inserted today."), (2, d(2024, 2, 1), "ENT", "left EAR, cholesteatoma found"), (3, d(2024, 1, 20), "GP", "nothing"), (4, d(2024, 9, 1), "GP", None)], "note_id long, note_date date, note_class string, note_text string")
    s = spark.createDataFrame([("e", "Left ear cholesteatoma found"), ("e", "grommet inserted today"), ("e", "tiny"), ("f", "Left ear, cholesteatoma found"), ("g", "does not occur anywhere at all")], "episode string, snippet string")
    c = spark.createDataFrame([("f", d(2024, 2, 3))], "episode string, adm date")
    got = {r.episode: r for r in notes.anchors(n, s, c).collect()}
    assert (got["e"].note_id, got["e"].matched, got["e"].tried, got["e"].gap) == (1, 2, 2, None)
    assert (got["f"].note_id, got["f"].matched, got["f"].gap) == (2, 1, 2) and "g" not in got
    a = notes.anchors(n, s, c)
    b = {r.episode: r for r in notes.bundles(a, notes.windows(a, n)).collect()}
    assert [x.note_id for x in b["e"].notes] == [1, 3] and b["e"].anchor_suspect and b["e"].episode_id == "e_20240101" and not b["f"].anchor_suspect


def plain_anchor(notes_, snippets):
    """(episode, note) -> snippets contained, by plain string search."""
    import re

    canonical = lambda t: re.sub("[^a-z0-9 ]", " ", re.sub(r"\s+", " ", (t or "").lower())).strip(" ")
    out = {}
    for e, s in snippets:
        c = canonical(s)
        for n, t in notes_:
            if len(c) >= 12 and c[:60] in canonical(t):
                out[e, n] = out.get((e, n), 0) + 1
    return out


def test_anchors_against_plain_search(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.choice([1, 2, 3, 6, 8, 14, 20])))
    texts = ["".join(rng.choice([" ", "  ", ", ", "-"]) + word() for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "x" * 50_000]
    snippets = []
    for e in range(120):
        t = rng.choice(texts[:60])
        at = rng.randint(0, max(0, len(t) - 12))
        snippets.append((e % 30, t[at : at + rng.choice([12, 13, 14, 18, 25, 80])]))  # begins and ends inside words
    snippets += snippets[:5] + [(1, "too short"), (2, None), (3, "x" * 30)]
    rows = [(k, datetime.date(2024, 1, 1 + k % 28), t, k % 2) for k, t in enumerate(texts)]
    n = spark.createDataFrame(rows, "note_id long, note_date date, note_text string, person int")
    asked = spark.createDataFrame([(e, s, e % 2) for e, s in snippets], "episode long, snippet string, person int")
    none = spark.createDataFrame([], "episode long, adm date")
    for on in (None, ["person"]):
        want = {}
        found = plain_anchor([(k, t) for k, _, t, _ in rows], snippets)
        for (e, k), m in sorted(found.items()):
            if on is None or e % 2 == k % 2:
                want[e] = min(want.get(e, (0,)), (-m, rows[k][1], k))
        got = {r.episode: (-r.matched, r.note_date, r.note_id) for r in notes.anchors(n, asked, none, on).collect()}
        assert got == want and len(want) >= 20
    assert "NestedLoop" not in notes.anchors(n, asked, none)._jdf.queryExecution().toString()


def test_numbers_and_minima_of_groups(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.01, 0.02, 0.5, 1.0]) if rng.random() < 0.7 else rng.random(), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "family string, p double, k int").repartition(7)
    got = ranked.numbered(df, ["family"], ["p"]).collect()
    for f in ("a", "b", None):
        own = sorted((r._n, r.p, r._size) for r in got if r.family == f)
        assert [x[0] for x in own] == list(range(len(own))) and [x[1] for x in own] == sorted(x[1] for x in own) and {x[2] for x in own} == {len(own)}
    q = agreement.benjamini_hochberg(df, family=("family",)).collect()
    assert len(q) == len(rows)
    for f in ("a", "b", None):
        own = sorted((r.p, r.q) for r in q if r.family == f)
        least = 1.0
        for rank in range(len(own), 0, -1):
            least = min(least, own[rank - 1][0] * len(own) / rank)
            assert abs(own[rank - 1][1] - least) < 1e-12
    assert agreement.benjamini_hochberg(df.limit(0), family=("family",)).count() == 0


def test_lcg_means_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 7)
    units = [(pair, k, float(k * k % 11) if k % 5 else None) for pair, n in (("p", 40), ("q", 3)) for k in range(n)]
    got = {(r.pair, r.draw): r.x for r in resample.lcg_means(spark.createDataFrame(units, "pair string, key int, x double"), ["x"], 6).collect()}
    for pair, n in (("p", 40), ("q", 3)):
        own = [x for p, _, x in units if p == pair]
        for draw in range(6):
            taken = [own[(draw * 7919 + pos * 104729 + draw * pos + 12345) % 1000003 % n] for pos in range(n)]
            taken = [x for x in taken if x is not None]
            assert got[pair, draw] == pytest.approx(sum(taken) / len(taken)) if taken else got[pair, draw] is None


def test_rater_pairs(spark):
    found = agreement.rater_pairs(spark.createDataFrame([(2, "c"), (0, "b"), (1, "a"), (1, "a")], "ord int, rater string")).collect()
    assert sorted(map(tuple, found)) == [("a vs c", "a", "c"), ("b vs a", "b", "a"), ("b vs c", "b", "c")]


def test_adjudication(spark):
    rows = [("m", c) for c, k in (("TP", 6), ("FP_soft", 3), ("FP_hard", 1), ("FN_coding", 2), ("FN_miss", 2)) for _ in range(k)] + [("z", "FP_hard"), ("z", "FN_other"), ("z", "AMBIG")]
    got = {r.model: r for r in adjudication.evaluate(spark.createDataFrame(rows, "model string, category string")).collect()}
    m = got["m"]
    assert [round(x, 4) for x in (m.validity_precision, m.alignment_precision, m.alignment_recall, m.extraction_recall, m.coding_accuracy, m.hallucination_rate)] == [0.9, 0.6, 0.6, 0.8, 0.75, 0.1]
    assert got["z"].n == 3 and got["z"].fn_miss == 1 and got["z"].validity_f1 is None
    cells = [("A template", 0, r, 1, "TP") for r in range(2, 9)] + [("S1", 1, 1, 1, "Qualifier "), ("S1", 1, 1, 2, "Verdict"), ("S1", 1, 2, 1, "Diagnoses"), ("S1", 1, 2, 2, "TP"), ("S1", 1, 3, 2, "fp"), ("S2", 2, 2, 1, "TP"), ("S2", 2, 3, 1, "tn")]
    df = spark.createDataFrame(cells, "sheet string, sheet_ord int, row int, col int, value string")
    assert tuple(adjudication.verdict_column(df).first()) == ("S1", 2)
    assert sorted((r.category, r.qualifier, r.position) for r in adjudication.graded_rows(df).collect()) == [("FP_hard", "none", ""), ("TP", "diagnoses", "")]


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [("p", str(k), float(v), None if k % 3 == 0 else float(v) / 2) for k, v in enumerate(rng.random(400))]
    units = spark.createDataFrame(rows, "pair string, key string, dx double, px double")
    d = resample.bootstrap(units, ["dx", "px"], 400).toPandas()
    dx = np.array([r[2] for r in rows])
    assert len(d) == 400 and abs(d.dx.mean() - dx.mean()) < 0.01 and abs(d.dx.std() - dx.std() / 20) < 0.004
    again = resample.bootstrap(units.repartition(7), ["dx", "px"], 400).toPandas().sort_values("draw")
    assert np.allclose(d.sort_values("draw").dx, again.dx)
    same = units.withColumns({"m": F.lit(1), "c": F.lit(1), "dx_m": F.col("dx"), "px_m": F.col("px"), "dx_c": F.col("dx"), "px_c": F.col("px")})
    assert resample.paired_test(same, 50).first().delta_kappa_p == 2.0


def test_every_draw_takes_as_many_units_as_there_are(spark):
    """Groups of any size, one with a missing value in every unit: the weights of each draw sum to the group's size."""
    sizes = {"one": 1, "few": 9, "some": 40, "many": 3000}
    rows = [(g, k, 1.0, float(k), None if g == "few" else 1.0 if k % 3 else None) for g, n in sizes.items() for k in range(n)] + [(None, 5, 1.0, 2.0, 3.0)]
    units = spark.createDataFrame(rows, "pair string, key int, x double, y double, z double")
    found = resample.draws(units, ["x", "y", "z"], 300)
    d = found.toPandas()
    assert len(d) == 300 * 5 and (d.x_sum == d.n).all() and (d.x_w == d.n).all() and (d.y_w == d.n).all()
    assert {g: set(d.n[d.pair == g]) for g in sizes} == {g: {n} for g, n in sizes.items()}
    assert (d.z_w[d.pair == "few"] == 0).all() and d.z_w[d.pair == "many"].std() > 0
    y = d.y_sum[d.pair == "many"] / 3000
    assert abs(y.mean() - 1499.5) < 4 and abs(y.std() - 866 / np.sqrt(3000)) < 2.5
    again = resample.draws(units.repartition(5), ["x", "y", "z"], 300).toPandas()
    order = ["pair", "draw"]
    assert d.sort_values(order, ignore_index=True).equals(again.sort_values(order, ignore_index=True)[d.columns])


def test_weights_of_a_unit_are_binomial(spark):
    """How often a unit is taken: the mean and spread of n draws of one in n, for rates of 0, in between and near 1."""
    for n in (5, 100, 2000):
        units = spark.createDataFrame([("p", k, 1.0 if k == 3 else 0.0) for k in range(n)], "pair string, key int, x double")
        taken = resample.draws(units, ["x"], 2000).toPandas().x_sum
        assert abs(taken.mean() - 1) < 0.09 and abs(taken.var() - (1 - 1 / n)) < 0.12, n
        assert taken.max() <= 9


def test_power(spark):
    assert math.isclose(power.bivariate_cdf(0, 0, 0.5), 0.25 + math.asin(0.5) / (2 * math.pi), abs_tol=1e-9)
    assert abs(power.tetrachoric(40, 10, 10, 40) - math.sin(math.pi / 2 * 0.6)) < 1e-3
    assert math.isclose(power.t_quantile(0.95, 10), 1.8124611, abs_tol=1e-5)
    grid = spark.createDataFrame([(100, 0.52, 0.52, 0.4), (100, 0.82, 0.52, 0.4)], "n int, p_model double, p_coder double, phi double")
    got = {r.p_model: r.power for r in power.mcnemar_power(grid, 2000).collect()}
    assert got[0.52] < 0.08 and got[0.82] > 0.95
    assert power.outlier_power(spark.createDataFrame([(40, 0.65, 0.3, 0.4, 2)], "n_triple int, p_mm double, rho double, delta double, items int"), 500).first().power > 0.9
    assert 0.03 < power.design(spark.createDataFrame([(20, 20, 0.65, 0.3, 2)], "n_triple int, n_double int, p_mm double, rho double, items int"), 20, 100).first().halfwidth < 0.2


def test_posthoc_power_of_the_true_size(spark):
    rows = [("large", 40_000, 15_000, 15_000, 40_000), ("unsolvable", 0, 100, 100, 0), ("never", 0, 0, 50, 50)]
    counts = spark.createDataFrame(rows, "pair string, both_hit long, a_only long, b_only long, neither long")
    got = {r.pair: r for r in power.posthoc(counts).collect()}
    assert got["large"].n == 110_000 and got["large"].mde_80 == got["large"].mde_95 == 0.02
    assert math.isnan(got["unsolvable"].phi)
    assert got["unsolvable"].power == power.exact_power(200, 0.5, 0.5, 0.2) and got["unsolvable"].mde_80 == power.minimum_detectable(200, 0.5, 0.2, 0.8)
    assert got["never"].p_model == 0 and got["never"].power == pytest.approx(1)
    assert power.posthoc(counts.limit(0)).collect() == [] and "collect" not in inspect.getsource(power.posthoc)


def test_exact_power_against_enumeration(spark):
    def plain(n, *cells):
        _, a, b, _ = power._cells(*cells)
        total = 0.0
        for x in range(n + 1):
            for y in range(n + 1 - x):
                if x + y and (abs(x - y) - 1) ** 2 / (x + y) > 3.841458820694124:
                    total += math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(n - x - y + 1) + x * math.log(a) + y * math.log(b) + (n - x - y) * math.log(1 - a - b))
        return total

    for n, *cells in ((5, 0.6, 0.5, 0.3), (40, 0.62, 0.52, 0.4), (120, 0.7, 0.52, 0.2), (90, 0.98, 0.9, 0.1)):
        assert abs(power.exact_power(n, *cells) - plain(n, *cells)) < 1e-9
    grid = spark.createDataFrame([(300, 0.64, 0.52, 0.4)], "n int, p_model double, p_coder double, phi double")
    assert abs(power.mcnemar_power(grid, 4000).first().power - power.exact_power(300, 0.64, 0.52, 0.4)) < 0.03
    tails = power.binomial_tail(np.array([0, 1, 3, 7, 8]), np.array([7, 7, 7, 7, 7]), 0.3)
    assert np.allclose(tails, [1, 1 - 0.7**7, sum(math.comb(7, k) * 0.3**k * 0.7 ** (7 - k) for k in range(3, 8)), 0.3**7, 0], atol=1e-12)


def test_cell_counts_are_those_of_pairs():
    rng = np.random.default_rng(5)
    x = rng.standard_normal(400_000)
    y = 0.4 * x + math.sqrt(1 - 0.4**2) * rng.standard_normal(400_000)
    m, c = x < NormalDist().inv_cdf(0.62), y < NormalDist().inv_cdf(0.52)
    want = [(m & c).mean(), (m & ~c).mean(), (~m & c).mean(), (~m & ~c).mean()]
    assert np.allclose(power._cells(0.62, 0.52, 0.4), want, atol=0.004)


def test_bundles_hold_what_is_asked_of_a_note(spark):
    """Notes by date and id, also when only a short form of them is gathered and there is no column of texts."""
    day = lambda k: datetime.date(2024, 1, k)
    anchored = spark.createDataFrame([(1, 3, day(5), 1, 1, None)], "episode int, note_id int, note_date date, matched int, tried int, gap int")
    n = spark.createDataFrame([(k, day(9 - k // 2)) for k in range(8)], "note_id int, note_date date")
    found = notes.bundles(anchored, notes.windows(anchored, n), note=F.concat_ws(":", "note_id", F.col("is_anchor").cast("int"))).first()
    assert found.notes == ["6:0", "7:0", "4:0", "5:0", "2:0", "3:1", "0:0", "1:0"] and found.n_notes == 8


def test_weights_in_parts_are_those_of_plain_remainders():
    """Every rate, numbers at both ends and those about a step of the weights or a multiple of the modulus."""
    rng, every, p = np.random.default_rng(5), np.arange(2000), resample.MODULUS
    u, v = (np.concatenate([[0, 0, 2**28 - 1, 2**28 - 1], rng.integers(0, 2**28, 30)]) for _ in range(2))
    for rate in (0, 1, 30, 63, 64):
        x = (u[:, None] * resample.FACTORS[0] + every * resample.FACTORS[1] + 12345) % p
        y = (x * x + v[:, None] + every * resample.FACTORS[2]) % p
        plain = np.searchsorted(resample.POISSON[rate], (y * y + x) % p, "right")
        assert (np.concatenate(list(resample._weights(u, v, rate, every.astype(np.uint64)))) == plain).all()


def test_draws_are_dealt_to_as_many_tasks_as_shuffles_have(spark):
    """Few units are few bytes, which adaptive plans would put into one task."""
    rows = spark.createDataFrame([("p", k, k, 64, float(k)) for k in range(400)], "pair string, _u long, _v long, _rate int, x double")
    every = np.arange(50, dtype=np.uint64)
    parts = resample.summed(rows, "pair", ["x"], 50, ["s", "n", "w"], lambda own: resample._weights(own["_u"], own["_v"], 64, every))
    assert parts.count() == 4 * 50


def test_an_episode_is_one_row_for_all_pairs(spark):
    """Annotations go through one shuffle whatever the number of pairs, and units are counted without another."""
    raters = [f"r{k}" for k in range(6)]
    rows = spark.createDataFrame([(r, str(e), "dx", p, f"A{(p + e) % 7}{k}") for k, r in enumerate(raters) for e in range(20) for p in range(3)], ANN)
    pairs = agreement.rater_pairs(spark.createDataFrame(list(enumerate(raters)), "ord int, rater string"))
    pairs = spark.createDataFrame(pairs.collect())
    units = agreement.kappa_units(agreement.comparisons(rows, pairs))
    assert units.count() == 15 * 20
    plan = units._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(key") <= 1 and "Window" not in plan


def test_lcg_means_by_counts(spark, monkeypatch):
    """Counted without a row for each place: the same means, and the same counts on both sides of the modulus."""
    units = [(pair, k, float(k * k % 11) if k % 5 else None) for pair, n in (("p", 40), ("q", 3)) for k in range(n)]
    units = spark.createDataFrame(units, "pair string, key int, x double")
    by_places, by_counts = ({(r.pair, r.draw): r.x for r in resample.lcg_means(units, ["x"], 6, least=n).collect()} for n in (100, 1))
    assert len(by_places) == 12 and by_counts == pytest.approx(by_places)
    monkeypatch.setattr(resample, "_M", 211)
    for n in (1, 7, 210, 211, 212, 500, 1000):
        got = np.concatenate(list(resample._lcg_weights(np.arange(n), n, 30)))
        for draw in range(30):
            taken = [(draw * 7919 + pos * 104729 + draw * pos + 12345) % 211 % n for pos in range(n)]
            assert (got[:, draw] == np.bincount(taken, minlength=n)).all()


def test_episodes_are_shuffled_once(spark):
    rows = spark.createDataFrame([("r", str(k % 9), "dx", k, f"A{k % 5}") for k in range(90)], ANN)
    found = annotations.episodes(rows)
    assert found.count() == 9 and found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_left_places_are_packed_by_blocks_of_units(spark):
    """The units that the counted indices give, from a row for each draw and block instead of one for each place, made by all tasks."""
    left = spark.createDataFrame([("p", d, 150_000, 3_000 + d) for d in range(6)] + [(None, 0, 1, 1)], "pair string, draw int, n long, _left long")
    found = resample.filled(left, "pair", 42)
    assert found.rdd.getNumPartitions() == 4
    rows = found.collect()
    assert len(rows) == 6 * 3 + 1
    m, (f0, f1, f2) = resample.MODULUS, resample.FACTORS
    for d in range(6):
        want = []
        for place in range(3_000 + d):
            x = (place * f0 + d * f1 + 12345 + 42) % m
            y = (x * x + place + d * f2) % m
            want.append((y * y + x) % m * 150_000 // m)
        got = [r._block * resample.RANKS + k for r in rows if r.pair == "p" and r.draw == d for k in resample._ranks(r._ranks)]
        assert sorted(got) == sorted(want)


def test_draws_over_several_blocks_of_units(spark, monkeypatch):
    """Blocks of 8 units: every draw takes n of n, and the sums are those of blocks that hold all units."""
    units = spark.createDataFrame([("p", k, 1.0, float(k % 13) if k % 5 else None) for k in range(3000)], "pair string, key int, x double, y double")
    whole = resample.draws(units, ["x", "y"], 40).toPandas().sort_values("draw", ignore_index=True)
    monkeypatch.setattr(resample, "RANKS", 8)
    parts = resample.draws(units, ["x", "y"], 40).toPandas().sort_values("draw", ignore_index=True)
    assert (parts.x_sum == 3000).all() and parts.equals(whole)


def test_tiles_are_the_weights_of_plain_remainders():
    """Tiles of any shape, and a table so coarse that most numbers are computed exactly."""
    rng, every, p = np.random.default_rng(6), np.arange(700), resample.MODULUS
    u, v = (rng.integers(0, 2**28, 300) for _ in range(2))
    x = (u[:, None] * resample.FACTORS[0] + every * resample.FACTORS[1] + 12345) % p
    y = (x * x + v[:, None] + every * resample.FACTORS[2]) % p
    plain = np.searchsorted(resample.POISSON[63], (y * y + x) % p, "right")
    for bits in (15, 3):
        resample._by_share.cache_clear()
        try:
            resample._BITS, own = bits, resample._BITS
            got, at = np.full(plain.shape, -1), 0
            for first, weight in resample._tiles(u, v, 63, every):
                got[at : at + len(weight), first : first + weight.shape[1]] = weight
                at += len(weight) if first + weight.shape[1] == 700 else 0
        finally:
            resample._BITS = own
            resample._by_share.cache_clear()
        assert (got == plain).all()
