import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import quality as Q
from marlstone.llm import toxicity as T
from marlstone.llm.common import crc_held_out
from marlstone.llm.labelled import training_rows

SF = "/root/testdata/sf0.01"


def test_held_out_rule(spark):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), crc_held_out().alias("held"))
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows.collect())


def test_training_never_sees_the_fold_and_is_bounded(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = training_rows(docs, labels, "quality", 50).collect()
    assert len(got) == 50 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)


@pytest.mark.parametrize(("kind", "label", "least"), [(Q, "quality", 0.93), (T, "toxic", 0.9)])
def test_held_out_accuracy(spark, kind, label, least):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    scores = kind.scored(docs, kind.fit(docs, labels)).where(crc_held_out()).join(labels, "doc_id").select("score", "predicted", label).toPandas()
    assert scores.score.between(0, 1).all()
    assert (scores.predicted == scores[label]).mean() >= least


@pytest.mark.parametrize(("kind", "label"), [(Q, "quality"), (T, "toxic")])
def test_edge_cases(spark, kind, label):
    schema = "doc_id long, text string, score string, y int, fold int"
    docs = spark.createDataFrame([(1, None, "s", 1, 1), (2, "", "s", 1, 1), (None, "you idiot", "s", 1, 1), (3, "word " * 100_000, "s", 1, 1), (3, "x" * 300_000, "s", 1, 1), (4, "good words", "s", 1, 1)], schema)
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, None), (None, 1), (4, 0), (4, 1)], f"doc_id long, {label} int")
    model = kind.fit(docs, labels)
    got = kind.scored(docs, model, score_col="s2").collect()
    assert len(got) == 6 and all(0 <= r.s2 <= 1 for r in got)
    assert len({r.s2 for r in got if not r.text}) == 1
    none = kind.fit(docs.limit(0), labels.limit(0))
    assert all(abs(r.s2 - 0.5) < 1e-6 for r in kind.scored(docs, none, score_col="s2").collect())
    assert kind.scored(docs.limit(0), model, score_col="s2").count() == 0


def test_slices_do_not_change_features(monkeypatch):
    text = " ".join(f"word{i}" for i in range(3000))
    whole = np.sort(np.concatenate(list(Q.features(text))))
    monkeypatch.setattr(Q, "SLICE", 500)
    parts = np.concatenate(list(Q.features(text)))
    assert abs(len(parts) - len(whole)) < 0.05 * len(whole)  # only pairs across cuts differ


def test_repetition_shows():
    a, b = (set(np.concatenate(list(Q.features(t))).tolist()) for t in ("one one two two", "six six ten ten"))
    assert a & b


def test_words_of_all_kinds():
    assert T.word_bits("idiot!") & T.INSULT and T.word_bits("IDIOT") & T.CAPS
    assert T.word_bits("1d1ot") & T.HIDDEN and T.word_bits("id.iot") & T.HIDDEN and not T.word_bits("river") & T.INSULT
    assert T.word_bits("you") & T.SECOND and T.word_bits("sooo") & T.STRETCHED
    near = T.dense_features("you are an idiot", T.WordCache())
    far = T.dense_features("idiot " + "word " * 50 + "you", T.WordCache())
    k = T.NAMES.index("near_second_person_per_100")
    assert near[k] > 0 and far[k] == 0


def test_cache_is_cleared_without_changing_features(monkeypatch):
    texts = [f"you idiot number {i} " + " ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    plain = [T.dense_features(t, T.WordCache()) for t in texts]
    monkeypatch.setattr(T, "CACHE_WORDS", 50)
    cache = T.WordCache()
    assert all((T.dense_features(t, cache) == p).all() for t, p in zip(texts, plain))


def test_trees_and_calibration():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, len(T.NAMES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = T.train(x, y)
    s = forest.score(x)
    assert ((s > 0.5) == (y > 0.5)).mean() > 0.95 and (np.diff(forest.y) >= 0).all() and abs(s.mean() - y.mean()) < 0.05


def test_features_against_a_reading_word_by_word(monkeypatch):
    import random

    r = random.Random(6)
    words = "you your idiot idiots 1diot STUPID damn, kill! river tree sooo ab1c Hello a b; mooron d-a-m-n".split()
    lexicon = {"river": 2.5, "tree": 3.0}
    monkeypatch.setattr(T, "SLICE", 40)
    for _ in range(60):
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 60)))
        tokens = text.split()
        traits = [T.word_traits(t) for t in tokens]
        n, bits = len(tokens), [t[0] for t in traits]
        bad, second = ([i for i, b in enumerate(bits) if b & kind] for kind in (T.BAD, T.SECOND))
        taught = [t[1] for t in traits if t[1] in lexicon]

        def share(kind):
            return 100 * sum(b & kind > 0 for b in bits) / n

        want = {
            "insults_per_100": share(T.INSULT), "distinct_insults": len({traits[i][1] for i in bad}), "profanity_per_100": share(T.PROFANE), "threats_per_100": share(T.THREAT),
            "near_second_person_per_100": 100 * sum(any(abs(i - j) <= T.NEAR for j in second) for i in bad) / n, "most_in_window": max((sum(i <= j < i + T.CLUSTER for j in bad) for i in bad), default=0),
            "caps_word_share": share(T.CAPS) / 100, "obfuscated_per_100": share(T.HIDDEN), "mixed_per_100": share(T.MIXED), "stretched_per_100": share(T.STRETCHED), "mean_word_length": sum(map(len, tokens)) / n,
            "capital_share": sum(map(str.isupper, text)) / max(1, sum(map(str.isalpha, text))), "learned_per_100": 100 * len(taught) / n, "distinct_learned": len(set(taught)), "learned_weight": sum(lexicon[w] for w in taught),
        }
        got = dict(zip(T.NAMES, T.dense_features(text, T.WordCache(lexicon))))
        assert {k: got[k] for k in want} == pytest.approx(want)


def test_first_split_against_every_split():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 4))
    y = (x[:, 2] + 0.3 * r.normal(size=300) > 0.4).astype(float)
    forest = T.Forest().fit(x, y, trees=1)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))

    def gain(mask):
        return sum(g[m].sum() ** 2 / (h[m].sum() + T.L2) for m in (mask, ~mask)) - g.sum() ** 2 / (h.sum() + T.L2)

    cuts = [(gain(x[:, f] <= c), f, c) for f in range(4) for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, T.BINS + 1)[1:-1])) if T.MIN_ROWS <= (x[:, f] <= c).sum() <= 300 - T.MIN_ROWS]
    best = max(cuts)
    assert forest.feature[0][0] == best[1] == 2 and forest.cut[0][0] == pytest.approx(best[2])


def test_training_tells_documents_apart():
    rows = [(np.array([1, 5]), np.array([0.5, 0.5]), 1), (np.array([2, 9]), np.array([0.5, 0.5]), 0)] * 40
    values, bias = Q.train(rows, buckets=16, dim=4, epochs=8)
    p = [1 / (1 + np.exp(-(float(s @ values[i]) + bias))) for i, s, _ in rows[:2]]
    assert p[0] > 0.8 and p[1] < 0.2


def test_a_repeated_label_row_is_one_row_of_the_sample(spark):
    docs = spark.range(100_000).select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7).alias("text"), F.lit(1).alias("_y_doc"), F.lit(1).alias("y"))
    labels = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    assert zlib.crc32(b"2") % 5 and training_rows(docs, labels, "quality", 50).count() == 1


def test_the_sample_is_bounded_in_bytes(spark):
    sample = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x "), 500).alias("text"), F.lit(1).alias("y"))
    left = Q.within_bytes(sample, 10 * 8 * 4004, 1 << 16).count()
    assert left == 10 and Q.within_bytes(sample, 10 * 8 * 64, 64).count() == 10


def test_a_shared_folder_is_asked_for_outside_of_one_process(monkeypatch):
    from marlstone.llm import common

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        sparkContext, conf = Context, {}

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
