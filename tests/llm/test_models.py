import numpy as np
import pytest
from helpers import awkward, nothing

from folioq.llm import quality, queries, toxicity
from folioq.llm.features import PART, Features, dot
from folioq.llm.training import Sample, logistic

SF = "/root/testdata/sf0.1"


def test_features_are_the_same_however_texts_come():
    f = Features(bits=10)
    texts = ["A b  c", None, "", "b c a a", "x" * 50, "é ß\tq\nz", "w " * 2000]
    row, feature, value = f.rows(texts)
    assert set(row) == {0, 3, 4, 5, 6}
    for k, t in enumerate(texts):
        r, g, v = f.rows([t])
        assert (g == feature[row == k]).all() and np.allclose(v, value[row == k])
    assert np.allclose(np.bincount(row, value**2, len(texts))[[0, 3, 4, 5, 6]], 1)


def test_very_long_texts_go_in_parts():
    f = Features(bits=12, repeats=False)
    words = [f"w{i % 700}" for i in range(PART // 3)]
    t = " ".join(words)
    assert len(t) > PART
    _, g, v = f.rows(["a", t, "b"])
    counts = np.expm1(v / v.max())
    assert len(g) > 700 and counts.min() > 0


@pytest.mark.parametrize("part", [64, 100, 1000])
def test_parts_change_nothing(monkeypatch, part):
    """A text that goes in parts has the features that it has as a whole: no word, repeat or seam is lost."""
    from folioq.llm import features

    f = Features(bits=16)
    texts = [" ".join(f"w{i % 9 // 3} w{i % 5}" for i in range(400)), "  \t a a\n a " * 60, "x " * 40 + "y" * 50 + " y" * 70, "日本語" * 15 + " 日本語 " * 30]
    whole = [f.rows([t]) for t in texts]
    monkeypatch.setattr(features, "PART", part)
    for t, (_, feature, value) in zip(texts, whole):
        longest = max(len(w.encode()) for w in t.split())
        _, g, v = f.rows([t])
        if longest <= part:
            assert (g == feature).all() and np.allclose(v, value)
        else:  # a run that is longer than a part counts as words of that length
            raw, runs = [w.encode() for w in t.split()], []
            for w in raw:
                runs += [w[i : i + part] for i in range(0, len(w), part)]
            assert {int(x) for x in g} and len(g) >= len(set(runs))


def test_whole_words_and_long_runs_count():
    f = Features(bits=20)
    apart = lambda a, b: set(f.rows([a])[1]) != set(f.rows([b])[1])
    assert apart("international", "internationally") and apart("привет", "приветы") and apart("日本語" * 40 + "猫" + "日本語" * 40, "日本語" * 40 + "犬" + "日本語" * 40)


def dense(x, y, weight, l2):
    """Newton's method on the whole problem, constant among the weights."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (weight * (p - y)) + l2 * w)
    return w


def test_logistic_fit_is_the_optimum():
    rng = np.random.default_rng(4)
    n, d = 300, 12
    x = rng.normal(size=(n, d)) * (rng.random((n, d)) < 0.5)
    extra, scale = rng.random((n, 2)), rng.uniform(0.5, 2, d)
    y = (x @ rng.normal(size=d) + rng.logistic(size=n) > 1).astype(float)
    weight = np.where(y > 0, 3.0, 1.0)
    weight[::7] = 0
    weight /= weight.sum()
    row, feature = np.nonzero(x)
    w, u = logistic(Sample(y[:, None], row, feature, x[row, feature]), d, extra, y, weight, scale, 1e-2, rounds=2000, close=1e-10)
    want = dense(np.column_stack([x * scale, extra]), y, weight, 1e-2)
    assert np.allclose(np.concatenate([w / scale, u]), want, atol=1e-5)


def test_chain_is_fitted_link_by_link():
    """A small chain against dense fits: later models see what models that have not seen a row say of it."""
    rng = np.random.default_rng(5)
    n, d = 200, 6
    x = rng.normal(size=(n, d))
    y = np.column_stack([(x[:, i] + x[:, i + 1] + rng.logistic(size=n) > 1) for i in range(3)]).astype(float)
    spec = toxicity.ChainSpec(l2=1e-2, features=Features(bits=4))
    row, feature = np.repeat(np.arange(n), d), np.tile(np.arange(d), n)
    chain = toxicity.fit_chain(Sample(y, row, feature, x.ravel()), spec)
    earlier, fold = np.zeros((n, 0)), np.arange(n) % spec.folds

    def by_hand(c, rows):
        t, share = y[rows, c], y[rows, c].mean()
        weight = np.where(t > 0, min(spec.balance, (1 - share) / share), 1.0)
        a, b = (t.sum() / t.sum()), ((1 - t).sum() / (1 - t).sum())  # every row has every feature here
        z = abs(a - b) / np.sqrt((0.5 / t.sum()) ** 2)
        scale = z / np.sqrt(((x[rows] * z) ** 2).sum() / rows.sum()) if z else 1.0
        w = dense(np.column_stack([x[rows] * scale, earlier[rows]]), t, weight / weight.sum(), spec.l2)
        return np.concatenate([w[:d] * scale, w[d:]])

    for c, link in enumerate(chain):
        want = by_hand(c, np.ones(n, bool))
        assert np.allclose(link.weights[:d], want[:d], atol=0.02) and np.allclose(link.before, want[d:-1], atol=0.02) and abs(link.constant - want[-1]) < 0.02
        unseen = np.zeros(n)
        for f in range(spec.folds):
            w = by_hand(c, fold != f)
            unseen[fold == f] = (1 / (1 + np.exp(-np.column_stack([x, earlier, np.ones(n)]) @ w)))[fold == f]
        earlier = np.column_stack([earlier, unseen])


def test_ordinal_model_finds_its_grades():
    rng = np.random.default_rng(1)
    n, d = 1500, 1 << 6
    x = rng.normal(size=(n, 8))
    true = np.array([2, -1, 0.5, 0, 0, 1, -2, 0.3])
    y = np.digitize(x @ true + rng.logistic(size=n), [-2, 0.5, 3]).astype(float)
    row, feature = np.repeat(np.arange(n), 8), np.tile(np.arange(8), n)
    spec = quality.QualitySpec(grades=4, features=Features(bits=6), l2=1e-5, steps=400, rate=0.1)
    m = quality.fit_ordinal(Sample(y[:, None], row, feature, x.ravel()), spec)
    assert np.allclose(m.weights[:8], true, atol=0.3) and np.allclose(m.thresholds, [-2, 0.5, 3], atol=0.4)
    assert (np.diff(m.thresholds) > 0).all() and (np.diff(m.tails(x @ true), axis=1) <= 0).all() and d == 64


def test_slope_is_the_losses():
    """Numeric derivative of the negative log likelihood against the thresholds that the fit settles on: near zero."""
    rng = np.random.default_rng(2)
    n = 300
    x, y = rng.normal(size=n), rng.integers(0, 3, n).astype(float)
    spec = quality.QualitySpec(grades=3, features=Features(bits=2), steps=2000, rate=0.05, l2=0.0)
    m = quality.fit_ordinal(Sample(y[:, None], np.arange(n), np.zeros(n, int), x), spec)

    def loss(w, t):
        tails = quality.Ordinal(np.array([w]), t).tails(x * w)
        p = -np.diff(np.concatenate([np.ones((n, 1)), tails, np.zeros((n, 1))], axis=1), axis=1)
        return -np.log(p[np.arange(n), y.astype(int)]).mean()

    at = loss(m.weights[0], m.thresholds)
    for e in (0.02, -0.02):
        assert loss(m.weights[0] + e, m.thresholds) >= at and loss(m.weights[0], m.thresholds + [e, 0]) >= at and loss(m.weights[0], m.thresholds + [0, e]) >= at


def held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    return docs, labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")


def test_quality_held_out(spark):
    docs, train, test = held_out(spark, SF)
    model = quality.train(docs, quality.grades(train))
    got = quality.score(docs, model).join(test, "doc_id").toPandas()
    assert got[got.quality == 1].selected.mean() > 0.98 and got[got.quality == 0].selected.mean() < 0.1
    assert ((got.expected_grade >= 0) & (got.expected_grade <= 2) & (got.p_tail >= 0) & (got.p_tail <= 1)).all()


def test_toxicity_held_out(spark):
    docs, train, test = held_out(spark, SF)
    chain = toxicity.train(docs, toxicity.categories(train))
    got = toxicity.score(docs, chain).join(test, "doc_id").toPandas()
    assert got[got.toxic == 1].flagged.mean() > 0.85 and got[got.toxic == 0].flagged.mean() < 0.01
    noise = got[(got.toxic == 1) & (got.quality == 0)]
    assert (noise.p_toxic_noise > 0.5).mean() > 0.5
    assert [len(x.before) for x in chain] == [0, 1, 2]
    assert (got.p_toxic >= got[["p_toxic_prose", "p_toxic_noise"]].max(axis=1)).all() and (got.flagged == (got.p_toxic > 0.5)).all()


def test_later_links_reach_the_verdict():
    """A text that only the last model knows is flagged."""
    spec = toxicity.ChainSpec(features=Features(bits=8))
    no, yes = np.zeros(256, np.float32), np.full(256, 9, np.float32)
    chain = [toxicity.Link(no, np.zeros(0), -3.0), toxicity.Link(no, np.zeros(1), -3.0), toxicity.Link(yes, np.zeros(2), -3.0)]
    p = toxicity.probabilities(["some words", ""], chain, spec)
    assert p[0, 0] == p[0, 2] > 0.5 and p[0, 1] < 0.1 and (p[1] < 0.1).all()


def test_ids_of_any_whole_type(spark):
    marks = spark.createDataFrame([(i, i % 2, i % 3 // 2) for i in range(60)], "doc_id int, quality int, toxic int")
    docs = spark.createDataFrame([(i, f"w{i % 2} t{i % 3}") for i in range(60)], "doc_id int, text string")
    for d in (docs, docs.selectExpr("cast(doc_id as bigint) doc_id", "text")):
        assert quality.score(d, quality.train(d, quality.grades(marks))).count() == 60
        assert toxicity.score(d, toxicity.train(d, toxicity.categories(marks))).count() == 60


@pytest.mark.parametrize("marks", [[], [(1, 1, 0), (2, 1, 0)], [(1, None, 1), (None, 1, 1), (2, 0, None)], [(1, 1, 1), (1, 0, 0), (2, 0, 1)]])
def test_awkward_tables(spark, marks):
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    df = awkward(spark)
    for docs in (df, nothing(spark)):
        model = quality.train(docs, quality.grades(labels))
        out = quality.score(docs, model).collect()
        assert len(out) == docs.count() and all(np.isfinite(r.expected_grade) for r in out)
        assert quality.selected_documents(docs, model).schema == docs.schema
        chain = toxicity.train(docs, toxicity.categories(labels))
        rows = toxicity.score(docs, chain).collect()
        assert len(rows) == docs.count() and all(0 <= r.p_toxic <= 1 for r in rows)


def test_same_in_every_run(spark):
    a, b = (queries.op2_quality_ordinal(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect() for _ in range(2))
    assert a == b and dot(np.array([0]), np.array([0]), np.array([2.0]), np.array([3.0]), 1)[0] == 6


def test_few_texts_at_a_time(monkeypatch):
    from folioq.llm import features

    f, weights = Features(bits=10), np.arange(1024) / 7
    texts = ["a b c " * k for k in range(40)] + [None]
    whole = dot(*f.rows(texts), weights, len(texts))
    monkeypatch.setattr(features, "PART", 100)
    assert np.allclose(f.each(texts, lambda r, g, v, n: dot(r, g, v, weights, n)), whole)
    assert len(f.each([], lambda r, g, v, n: dot(r, g, v, weights, n))) == 0
