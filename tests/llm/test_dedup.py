import brute
import pytest

from coilwave.llm import ngram_join, queries, substring_dedup, suffix_dedup


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("name", ["hard", "table"])
def test_repeated_passages(spark, small, request, name):
    docs = spark.read.parquet(f"{small}/documents.parquet") if name == "table" else request.getfixturevalue(name)
    got = substring_dedup.remove_repeats(docs, width=20)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeated_passages(pairs(docs)))


@pytest.mark.parametrize("width", [400, 40])
def test_repeated_strings(hard, width):
    got = suffix_dedup.remove_repeats(hard, width=width)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeated_strings(pairs(hard), width))


def test_repeated_strings_of_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = queries.op3_suffix_dedup(spark, small)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeated_strings(pairs(docs)))


def test_hot_anchors_are_counted_by_window(hard, monkeypatch):
    from coilwave.llm import windows

    spec = windows.Spec
    monkeypatch.setattr(substring_dedup, "Spec", lambda *a, **b: spec(*a, **b, hot=2))
    monkeypatch.setattr(suffix_dedup, "Spec", lambda *a, **b: spec(*a, **b, hot=2))
    got = substring_dedup.remove_repeats(hard, width=20)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeated_passages(pairs(hard)))
    got = suffix_dedup.remove_repeats(hard, width=40)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeated_strings(pairs(hard), 40))


def test_groups_at_the_edges_of_a_passage_are_not_one_route(spark, monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa

    from coilwave.llm import windows
    from coilwave.llm.shared import twinned

    r = random.Random(9)
    own = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, close = own(500), own(12)
    # Some texts share bytes beside the passage too, so that windows which reach out of it are repeats here and there.
    texts = [own(150) + (close if i % 50 == 0 else own(12)) + passage + own(150) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    spec = windows.Spec("byte", 400, 64, first_stays=False, hot=20, crowd=30)

    def rows_a_route(pieces, spec):
        route, n = np.unique([p[0] for p in pieces], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(route), pa.array(route), pa.array(n.astype(np.int32)), pa.array(np.full(len(n), -1, np.int32))], schema=windows.RUN)

    found = windows.repeated_runs(twinned(docs).select("key", "twin", "text"), spec, rows_a_route, 1).where("n = -1")
    assert max((row.start for row in found.collect()), default=0) <= spec.crowd
    monkeypatch.setattr(suffix_dedup, "Spec", lambda *a, **b: spec)
    got = suffix_dedup.remove_repeats(docs, width=400)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeated_strings(list(enumerate(texts)), 400))


def test_crowded_groups_of_hot_anchors(hard, monkeypatch):
    from coilwave.llm import windows

    spec = windows.Spec
    monkeypatch.setattr(substring_dedup, "Spec", lambda *a, **b: spec(*a, **b, hot=2, crowd=1))
    monkeypatch.setattr(suffix_dedup, "Spec", lambda *a, **b: spec(*a, **b, hot=2, crowd=1))
    got = substring_dedup.remove_repeats(hard, width=20)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.repeated_passages(pairs(hard)))
    got = suffix_dedup.remove_repeats(hard, width=40)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.repeated_strings(pairs(hard), 40))


@pytest.mark.parametrize("width,percent", [(5, 80), (2, 50), (1, 60)])
def test_jaccard_components(hard, width, percent):
    got = ngram_join.link(hard, width, percent)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(pairs(hard), width, percent))


def test_jaccard_components_of_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert rows(queries.op4_ngram_join(spark, small), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(pairs(docs)))


def test_jaccard_in_small_blocks_and_split_columns(hard, monkeypatch):
    for name, value in (("BLOCK_ROWS", 3), ("PAIRS_A_ROW", 0), ("SHORT", 2), ("SPLIT_LEVEL", 1), ("LEAST_LEVEL", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    got = ngram_join.link(hard, 1, 30)
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(pairs(hard), 1, 30))


@pytest.mark.parametrize("block", [512, 3])
def test_all_links_are_counted(spark, monkeypatch, block):
    import random

    for name, value in (("BLOCK_ROWS", block), ("COLUMNS_AT_ONCE", 50)):
        monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    # near copies of one text, not all of which link with each other; each up to three times
    texts = [" ".join("x" if r.random() < 0.01 * (i % 4) else w for w in words) for i in range(40)]
    texts = [None, "", *texts, *texts[::3], *texts[::6], "some other text of its own that is not near", "ab", "ab"]
    sets = [brute.BLANK.findall(t or "") for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in sets]
    near = [[i != j and bool(a) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = ngram_join.linked(docs)
    assert {x.doc_id: x.n_links for x in got.collect()} == {i: sum(own) for i, own in enumerate(near)}
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(list(enumerate(texts))))
    of, links = ngram_join.linked_pairs(docs)
    row = {x.doc_id: x.row for x in of.collect()}
    found = [(x.a, x.b) for x in links.collect()]
    assert len(found) == len(set(found)) and set(found) == {(row[i], row[j]) for i, own in enumerate(near) for j, hit in enumerate(own) if hit and row[i] < row[j]}


@pytest.mark.parametrize(("block", "percent"), [(4, 80), (2, 60), (3, 95)])
def test_links_between_texts_of_many_sizes(spark, monkeypatch, block, percent):
    """Beginnings of one text, of 20 to 90 words: one component of many classes of size, in which only near sizes link."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    words = [f"w{i}" for i in range(90)]
    texts = [" ".join(words[:n]) for n in range(20, 91)] + [" ".join(words[:n]) for n in (30, 31, 90)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    want = {i: sum(i != j and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.n_links for x in ngram_join.linked(docs, 5, percent).collect()} == want


def test_odd_rows(odd):
    assert substring_dedup.remove_repeats(odd).count() == suffix_dedup.remove_repeats(odd).count() == 6
    got = ngram_join.link(odd).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 0, 0), (0, 3, 7), (7, 1, 7), (7, 3, 7), (7, 3, 7), (8, 0, 8)]
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    # 7 has two different texts, one of them twice and also without doc_id; texts without words stay
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (7, "a b c d e f g"), (7, "z " * 30), (8, "")]


def test_hot_lists_of_few_strangers(spark, monkeypatch):
    """A large component, near misses of it that share its columns, and other components of the same columns, in small blocks."""
    import random

    for name, value in (("BLOCK_ROWS", 4), ("PAIRS_A_ROW", 0), ("SHORT", 2), ("SPLIT_LEVEL", 1), ("LEAST_LEVEL", 1)):
        monkeypatch.setattr(ngram_join, name, value)
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        own = words[: r.randint(30, 60)] if i % 3 else list(words)
        for _ in range(i % 5):
            own[r.randrange(len(own))] = f"x{r.randrange(40)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for width, percent in ((5, 80), (1, 80), (2, 60)):
        got = ngram_join.link(docs, width, percent)
        assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard_components(list(enumerate(texts)), width, percent))


@pytest.mark.parametrize("partitions", [1, 6])
def test_several_texts_of_one_doc_id(spark, partitions):
    import random

    r = random.Random(4)
    own = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(6)) for _ in range(n))
    p, q, z, u = own(40), own(200), own(30), own(80)
    texts = [(1, p), (7, q + " " + p), (7, "short"), (7, None), (9, z + " " + p + " " + own(5)), (9, u), (9, u), (None, u), (None, own(60)), (12, own(30) + " " + u), (12, "short")]
    key = lambda x: (x[0] is None, x)
    for rows_in in (texts, texts[::-1]):
        docs = spark.createDataFrame(rows_in, "doc_id long, text string").repartition(partitions)
        got = substring_dedup.remove_repeats(docs, width=20).select("doc_id", "n_words", "n_removed", "kept_sha256")
        assert sorted((tuple(x) for x in got.collect()), key=key) == sorted(brute.repeated_passages(texts), key=key)
        got = suffix_dedup.remove_repeats(docs, width=100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted((tuple(x) for x in got.collect()), key=key) == sorted(brute.repeated_strings(texts, 100), key=key)


def test_matching_statistics_of_a_foreign_text():
    import numpy as np

    from coilwave.llm.fm_index import FMIndex, matching_statistics

    r = np.random.default_rng(6)
    for depth, sigma, least in ((5, 3, 1), (5, 3, 3), (20, 4, 2), (3, 30, 1)):
        held = np.append(r.integers(1, sigma, 400), 0)
        held[100] = held[250] = 0
        text = r.integers(1, sigma + 3, 300)  # some symbols are not in the index
        text[40:80] = held[20:60]
        end, length = np.array([120, 121, 300]), np.array([120, 1, 179])
        match, row = matching_statistics(FMIndex(held, sigma, depth), text, end, length, least)
        places = lambda x: sum(np.array_equal(held[j : j + len(x)], x) for j in range(len(held)))
        stop = np.repeat(end, length)
        for i in range(300):
            m = match[i]
            assert m == 0 or places(text[i : i + m]) >= least
            assert m == min(depth, stop[i] - i) or places(text[i : i + m + 1]) < least


@pytest.mark.parametrize("letters,width", [(2, 20), (2, 33), (26, 8), (1, 30), (3, 7)])
def test_repeated_places(letters, width):
    import numpy as np

    from collections import Counter

    r = np.random.default_rng(letters + width)
    pieces = [bytes(r.integers(0, letters, int(n), dtype=np.uint8)) for n in r.integers(0, 150, 30)]
    pieces += [pieces[3] + b"q" * 40, pieces[4][5:], b"q" * 60, b"", pieces[5] + pieces[6], b"\0" * 50]
    n = Counter(p[i : i + width] for p in pieces for i in range(len(p) - width + 1))
    got = suffix_dedup.repeated_places(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]), width)
    assert got.tolist() == [i + width <= len(p) and n[p[i : i + width]] > 1 for p in pieces for i in range(len(p))]


def test_a_hot_cell_covers_its_anchors(spark):
    import numpy as np

    from coilwave.llm.windows import hot_anchors

    fps = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 500)
    hot = hot_anchors(spark.createDataFrame([(int(x),) for x in fps], "fp long"), 500)
    others = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 20_000)
    assert hot(fps.view(np.uint64)).all() and hot(others.view(np.uint64)).mean() < 0.15
    assert hot_anchors(spark.createDataFrame([], "fp long"), 500) is None


def test_runs_beyond_a_shorter_row_of_their_key():
    import numpy as np
    import pyarrow as pa

    from coilwave.llm.windows import covered

    kind = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
    run = {"start": 8, "n": 2}
    # texts of 4, 5 and 3 units; the first and the last have a run of a longer row
    runs = pa.array([[run], [{"start": 1, "n": 1}], [run]], kind)
    assert np.flatnonzero(covered(runs, np.array([0, 4, 9, 12]), 3)).tolist() == [5, 6, 7]


def test_empty_tables(empty):
    for got in (substring_dedup.remove_repeats(empty), suffix_dedup.remove_repeats(empty), ngram_join.link(empty), ngram_join.one_of_each(empty)):
        assert got.count() == 0
