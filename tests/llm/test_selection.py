import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import brute
import numpy as np
import pytest

from coilwave.llm import decontaminate, mixing, quality_cnn, quality_rules, queries, sharding


def both(df):
    return [(r[0], r[1]) for r in df.collect()]


@pytest.mark.parametrize("pass_bytes", [1 << 25, 60])
def test_benchmark_windows(spark, hard, monkeypatch, pass_bytes):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes if pass_bytes > 60 else 4000)
    docs = both(hard.select("doc_id", "text"))
    words = brute.ALNUM.findall(brute.lower(docs[10][1]))
    long = brute.ALNUM.findall(brute.lower(docs[-1][1]))
    items = [("a", " ".join(words[3:30]).upper()), ("b", "a b"), ("c", None), ("d", "..."), (None, "one two"), ("e", " ".join(long[:400])), ("a", "three four"), ("f", "one")]
    got = decontaminate.find_benchmark(hard, spark.createDataFrame(items, "item_id string, text string"))
    want = {r[0]: r for r in brute.contaminated(docs, [x for x in items if x[0]])}
    for r in got.collect():
        assert (r.n_words, r.n_hit, len(r["items"]), r.contaminated) == (want[r.doc_id][1], want[r.doc_id][2], want[r.doc_id][3], want[r.doc_id][5])


def test_benchmark_of_the_table(spark, small):
    docs = both(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text"))
    items = both(spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text"))
    got = sorted(tuple(r) for r in queries.op7_decontamination(spark, small).collect())
    assert got == sorted(brute.contaminated(docs, [(str(i), t) for i, t in items]))


def test_rule_counts(spark, hard, small):
    for docs in (hard, spark.read.parquet(f"{small}/documents.parquet")):
        text = dict(both(docs.select("doc_id", "text")))
        for r in quality_rules.judge(docs, "doc_id").collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rule_counts(text[r.row.doc_id])
            assert not (r.kept and r.base_failed)


def test_posteriors_against_a_plain_version(spark, small):
    """Bayes' rule in fractions of counts, rule by rule, from the same start."""
    import math

    got = quality_rules.judge(spark.read.parquet(f"{small}/documents.parquet"), "doc_id").collect()
    patterns = Counter(r.votes for r in got if not r.base_failed)
    every = {r.votes for r in got}
    total, kinds = sum(patterns.values()), range(len(quality_rules.RULES))
    good = {p: (p.count("g") + 8) / (p.count("g") + 10 * p.count("b") + 10) for p in every}
    for _ in range(100):
        share = min(0.95, max(0.05, (sum(patterns[p] * good[p] for p in every) + 8) / (total + 10)))
        chance = {}
        for label in (0, 1):
            for r in kinds:
                n = {o: sum(patterns[p] * (good[p] if label else 1 - good[p]) for p in every if p[r] == o) + 10 * sum(patterns[p] for p in every if p[r] == o) / total + 0.5 for o in "bg-"}
                chance |= {(label, r, o): n[o] / sum(n.values()) for o in "bg-"}
        for p in every:
            odds = math.log(share / (1 - share))
            for r in kinds:
                says = math.log(chance[1, r, p[r]] / chance[0, r, p[r]])
                odds += min(says, 0) if p[r] == "b" else max(says, 0) if p[r] == "g" else says
            good[p] = 1 / (1 + math.exp(-odds))
    for r in got:
        assert abs(r.p_good - good[r.votes]) < 1e-9 and r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_rules_agree_with_labels(spark):
    """The rules see no label; most good documents stay and many bad ones go."""
    folder = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in queries.op10_quality_rules(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality is not null").collect()
    good = [kept[r.doc_id] for r in labels if r.quality == 1]
    bad = [kept[r.doc_id] for r in labels if r.quality == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.02


def test_estimate_finds_the_accurate_rules():
    r, n = np.random.default_rng(3), len(quality_rules.RULES)
    counts = Counter()
    for _ in range(3000):
        good = r.random() < 0.7
        right = r.random(n) < np.where(np.arange(n) < n - 1, 0.9, 0.55)
        counts["".join("gb"[int(good != ok)] for ok in right)] += 1
    share, chances, posterior = quality_rules.estimate(counts)
    accuracy = (chances[0, :, 0] + chances[1, :, 1]) / 2
    assert abs(share - 0.7) < 0.05 and accuracy[:-1].min() > 0.85 > 0.7 > accuracy[-1]
    assert posterior["g" * n] > 0.99 > 0.01 > posterior["b" * n]


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op9_quality_classifier(spark, folder).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for k, r in got.items())
    held = [r for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality is not null").collect() if got[r.doc_id].held_out]
    score, label = np.array([got[r.doc_id].score for r in held]), np.array([r.quality for r in held])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in score[label == 1] for b in score[label == 0]])
    assert auc > 0.9


def test_classifier_gradient_and_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(7, 1), (8, 0), (None, 1), (9, None)], "doc_id long, quality int")
    assert quality_cnn.classify(odd, labels).count() == 6
    assert quality_cnn.classify(empty, labels).count() == 0
    assert quality_cnn.classify(odd, labels.limit(0)).where("score = 0.5").count() == 6


def test_targets():
    assert mixing.targets([100, 10, 10], [5, 2, 1], Fraction(3, 2), 2) == [Fraction(140), Fraction(20), Fraction(20)]
    assert mixing.targets([10, 0, 10], [5, 2, 1], Fraction(3, 2), 2) == [Fraction(20), 0, Fraction(10)]


def test_fill_reaches_what_can_be_reached():
    r = np.random.default_rng(1)
    for _ in range(50):
        lengths = np.unique(r.integers(1, 30, 6))
        counts = r.integers(1, 5, len(lengths))
        sums = {0}
        for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            for _ in range(c):
                sums |= {s + n for s in sums}
        budget = int(r.integers(0, int(lengths @ counts) + 5))
        take = mixing.fill(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert max(s for s in sums if s <= budget) - int(lengths.max()) < int(lengths @ take) <= budget


@pytest.mark.parametrize("name", ["hard", "table"])
def test_mix(spark, small, request, name):
    docs = spark.read.parquet(f"{small}/documents.parquet") if name == "table" else request.getfixturevalue(name)
    text = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    got = mixing.mix(docs, "doc_id").collect()
    assert sorted(r.row.doc_id for r in got) == sorted(text)
    sizes, taken, goal = defaultdict(int), defaultdict(int), {}
    for r in got:
        t, source = text[r.row.doc_id]
        assert r.size == len(brute.BLANK.findall(t or "")) and 0 <= r.times <= 2
        sizes[source] += r.size
        taken[source] += r.size * r.times
        goal[source] = r.target
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute.targets([sizes[s] for s in order])
    for s, t in zip(order, want, strict=True):
        own = [r.size for r in got if text[r.row.doc_id][1] == s]
        whole = int(t // sizes[s]) if sizes[s] else 0
        # every sum that some of the rows give, as bits
        sums = 1
        for n in own:
            sums |= sums << n
        nearest = min(abs(k + whole * sizes[s] - t) for k in range(sizes[s] + 1) if sums >> k & 1) if whole < 2 else 0
        assert goal[s] == float(t) and abs(taken[s] - t) <= nearest + Fraction(1, 2)
    again = {r.row.doc_id: r.times for r in mixing.mix(docs.repartition(3), "doc_id").collect()}
    assert again == {r.row.doc_id: r.times for r in got}
    assert mixing.mixed_rows(docs).count() == sum(r.times for r in got)


@pytest.mark.parametrize("partitions", [1, 5])
def test_mix_of_equal_rows(spark, partitions):
    rows = [(1, "a b c d e f g h i j", "s")] * 400 + [(None, None, "s")] * 5 + [(None, "a b c d e", "s")] * 30 + [(2, "x " * 100, "t")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(partitions)
    got = mixing.mix(docs, "doc_id").collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        s = "t" if r.row.doc_id == 2 else "s"
        sizes[s] += r.size
        taken[s] += r.size * r.times
    for s, t in zip("st", brute.targets([sizes[s] for s in "st"]), strict=True):
        assert abs(taken[s] - t) <= (5 if s == "s" else 50)
    assert Counter((r.row.doc_id, r.size, r.times) for r in got) == Counter((r.row.doc_id, r.size, r.times) for r in mixing.mix(docs.repartition(3), "doc_id").collect())


@pytest.mark.parametrize("name", ["hard", "table"])
def test_shards(spark, small, request, name):
    docs = spark.read.parquet(f"{small}/documents.parquet") if name == "table" else request.getfixturevalue(name)
    text = dict(both(docs.select("doc_id", "text")))
    got = sharding.shard(docs).collect()
    size, slots, by_text = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        assert (r.size, r.text_crc32) == brute.size_and_crc(text[r.doc_id]) and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        by_text[text[r.doc_id]].add(r.shard)
    assert len(got) == len(text) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in by_text.values())
    assert max(size.values()) <= sum(size.values()) / 16 + max(r.size for r in got) * 2


def test_smallest_capacity():
    r = np.random.default_rng(2)
    for _ in range(100):
        sizes = r.integers(1, 50, int(r.integers(1, 30)))
        k = int(r.integers(1, 6))
        best = {0: 0}
        table = np.full((k + 1, len(sizes) + 1), np.inf)
        table[0, 0] = 0
        for j in range(1, k + 1):
            for e in range(len(sizes) + 1):
                table[j, e] = min(max(table[j - 1, s], sizes[s:e].sum()) for s in range(e + 1))
        cap = sharding.smallest_capacity(sizes, k)
        assert cap == table[k, -1], best
        ends = sharding.even_cuts(np.cumsum(sizes), cap, k)
        assert ends[-1] == len(sizes) and max(np.add.reduceat(np.append(sizes, 0), np.append(0, ends[:-1]))[np.diff(np.append(0, ends)) > 0]) <= cap


def test_odd_and_empty(spark, odd, empty):
    items = spark.createDataFrame([("x", "a b c")], "item_id string, text string")
    for got, n in ((decontaminate.find_benchmark(odd, items), 6), (quality_rules.judge(odd, "doc_id"), 6), (mixing.mix(odd, "doc_id"), 6), (sharding.shard(odd), 6)):
        assert got.count() == n
    for keep in (lambda d: decontaminate.uncontaminated(d, items), quality_rules.filtered, mixing.mixed_rows):
        assert keep(odd).columns == odd.columns and keep(empty).count() == 0
    assert decontaminate.find_benchmark(odd, items.limit(0)).where("contaminated").count() == 0
    assert sharding.shard(empty).count() == mixing.mix(empty, "doc_id").count() == sharding.sharded_rows(empty).count() == 0
    placed = sharding.sharded_rows(odd)
    assert placed.columns == [c for c in odd.columns if c != "size"] + ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sorted((r.doc_id or 0, r.text or "") for r in placed.collect()) == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
