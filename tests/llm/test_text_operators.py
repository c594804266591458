"""Operators 11 to 13 against plain versions."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from coilwave.llm import byte_bpe, fill_middle, lexical_search, queries

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
HOW = {"ranks": RANKS, "pattern": public_tokenizers.PATTERN}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# --- ranked search ---


def terms(text):
    return Counter(TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def searched(docs, items, top=20):
    own = [(k, terms(t)) for k, t in docs]
    n_docs, n_terms = sum(1 for _, c in own if c), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for k, c in own:
            score = 0
            for t, q in terms(text).items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += q * w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * (75 + (25 * c.total() * n_docs) // n_terms)))
            if score > 0:
                found.append((-score, k is None, k or 0))
        out += [(item, i + 1, None if none else k, -s) for i, (s, none, k) in enumerate(sorted(found)[:top])]
    return out


def rows(df, *names):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(r) for r in df.select(*names).collect()), key=key)


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_search_on_hard_rows(spark, hard, monkeypatch):
    docs = [(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect()]
    items = [(i, t[len(t) // 3 : len(t) // 3 + 200]) for i, (_, t) in enumerate(docs) if t and len(t) > 60] + [(90, None), (91, ""), (92, "no such words"), (93, "one ONE two Three"), (None, "one"), (93, "two")]
    asked = spark.createDataFrame(items, "item_id int, text string")
    want = ordered(searched(docs, items))
    assert rows(lexical_search.search(hard, asked), "item_id", "rank", "doc_id", "score") == want
    monkeypatch.setattr(lexical_search, "BROADCAST_ROWS", 0)  # by shuffle
    monkeypatch.setattr(lexical_search, "GIVEN", 7)
    assert rows(lexical_search.search(hard, asked, top=3), "item_id", "rank", "doc_id", "score") == ordered(searched(docs, items, 3))


def test_search_on_odd_and_empty_tables(spark, odd, empty):
    items = spark.createDataFrame([(1, "A b zz z", 5, 6), (1, "A b zz z", 5, 6)], "item_id int, text string, term int, score int")
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = rows(lexical_search.search(odd.withColumns({"term": F.lit(1), "bucket": F.lit(2), "item": F.lit(3)}), items), "item_id", "rank", "doc_id", "score")
    assert got == ordered(searched(docs, [(1, "A b zz z")]) * 2) and len(got) > 4
    assert lexical_search.search(empty, items).count() == 0
    assert lexical_search.search(odd, items.limit(0)).count() == 0


def test_terms_in_blocks(monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 5)
    text = "Ab cd-ÄB " + "long" * 9 + "\x00x_y 7"
    assert lexical_search.counted(text.encode()) == Counter({k.encode(): v for k, v in terms(text).items()})


# --- fill in the middle ---


def transformed(doc_id, text, seed=42):
    text, units = text or "", UNIT.findall(text or "")
    digits = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h[3] % 100 < 80
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_middles_on_hard_rows(spark, hard, odd, empty):
    more = ["<P> a", "b<M>", "a <S", "S> <P x", "<", " " * 700, "w " * 256, "w " * 257 + "\t", "é漢 " * 600, "word" * 5000, "\n\x0bx\x1c y\x85z  end"]
    made = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more * 12)], "doc_id long, text string")
    for df in (hard.select("doc_id", "text"), odd, made):
        out = fill_middle.fill_in_middle(df.withColumn("output", F.lit(1)), *df.columns)
        back = fill_middle.restore(out, *out.columns)
        got = back.select("row.*", "restored").collect()
        assert len(got) == df.count()
        for r in got:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == transformed(r.row.doc_id, r.row.text)
            assert r.restored == (r.row.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.restore(fill_middle.fill_in_middle(empty, "doc_id")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a é漢\t\n😀", max_size=80), st.integers(1, 4), st.data())
def test_ropes_split_at_any_rank(text, size, data):
    units = UNIT.findall(text)
    rope = fill_middle.balanced([fill_middle.leaf("".join(units[i : i + size]).encode()) for i in range(0, len(units), size)])
    assert (rope.units, rope.chars, fill_middle.whole(rope)) == (len(units), len(text), text.encode())
    k = data.draw(st.integers(0, len(units)))
    a, b = fill_middle.split(rope, k, "units")
    assert (fill_middle.whole(a).decode(), a.units, b.units) == ("".join(units[:k]), k, len(units) - k)
    k = data.draw(st.integers(0, len(text)))
    a, b = fill_middle.split(fill_middle.concat(b, a), k, "chars")
    assert (a.chars, b.chars) == (k, len(text) - k)


# --- byte-level BPE ---


def test_tokens_as_the_library_gives_them(spark, hard, odd, empty, library):
    r = random.Random(3)
    pools = ["abcde the ing'sll", "0123456789 .,", "éüßñ", "漢字かな", "  \t\n\r　\x85\x1c", "😀👩‍👩‍👧", "<|endoftext|> ", "aAbB'tT'RE"]
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(1, 300))) for _ in range(400)] + ["a" * 3000, " " * 3000, "ab" * 2000, "<|endoftext|>", "\x00\x01"]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for df in (hard.select("doc_id", "text"), odd, made):
        coded = byte_bpe.encode(df.withColumns({"ids": F.lit(1), "n_tokens": F.lit(2)}), *df.columns, **HOW)
        got = byte_bpe.decode(coded, *coded.columns, **HOW).select("row.*", "data").collect()
        assert len(got) == df.count()
        for x in got:
            want = library.encode_ordinary(x.row.text or "")
            assert np.frombuffer(bytes(x.ids), "<u4").tolist() == want and x.n_tokens == len(want)
            assert bytes(x.data).decode() == (x.row.text or "")
    assert byte_bpe.encode(empty, "doc_id", **HOW).count() == 0


def test_tokens_of_whole_documents(spark, small, library):
    got = {r.doc_id: r for r in queries.op13_byte_bpe(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    for d in docs:
        want = np.array(library.encode_ordinary(d.text or ""), "<u4")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), sha(want.tobytes()), sha(d.text or ""))
    assert len(got) == len(docs)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="abthein gér漢", max_size=12), max_size=6), st.text(alphabet="abthein gér漢", max_size=9), st.data())
def test_appends_and_edits_of_prefix_tables(vocabulary, parts, new, data):
    table = byte_bpe.PrefixTokens(vocabulary)
    for p in parts:
        table.append(p.encode())
        assert table.last == byte_bpe.PrefixTokens(vocabulary, table.data).last
    start = data.draw(st.integers(0, len(table.data)))
    end = data.draw(st.integers(start, len(table.data)))
    whole = table.data[:start] + new.encode() + table.data[end:]
    table.edit(start, end, new.encode())
    assert table.data == whole and table.last == byte_bpe.PrefixTokens(vocabulary, whole).last
    other = whole[: data.draw(st.integers(0, len(whole)))] + b"xyz"
    table.become(other)
    assert table.tokens() == byte_bpe.PrefixTokens(vocabulary, other).tokens()
    assert b"".join(vocabulary.token[t] for t in table.tokens()) == other


def test_long_edits_stop_early(vocabulary, monkeypatch):
    data = bytes(random.Random(1).choices(b"etaoin shrdlu", k=4000))
    table = byte_bpe.PrefixTokens(vocabulary, data)
    done, plain = [], vocabulary.extended
    monkeypatch.setattr(vocabulary, "extended", lambda d, last, until: (done.append(until - len(last)), plain(d, last, until))[1])
    table.edit(100, 110, b"other words")
    assert sum(done) < 300 and table.last == byte_bpe.PrefixTokens(vocabulary, table.data).last


def test_edited_rows(spark, library):
    r = random.Random(9)
    word = lambda: "".join(r.choice("ab'ts1 \n\té.漢") for _ in range(r.randint(0, 40)))
    texts = [word() + word() + word() for _ in range(300)] + [None, "", "plain words only"]
    edits = []
    for i, t in enumerate(texts):
        a = r.randint(0, len(t or ""))
        edits.append((i, t, a, r.randint(a, len(t or "")), word()))
    edits.append((999, "abc", None, None, None))
    df = spark.createDataFrame(edits, "doc_id long, text string, start long, end long, new string")
    coded = byte_bpe.encode(df, *df.columns, **HOW).select("row.*", "ids")
    got = byte_bpe.reencode(coded, *coded.columns, **HOW).collect()
    assert len(got) == len(edits)
    for x in got:
        t, a, b = x.row.text or "", x.row.start or 0, x.row.end or 0
        assert x.text == t[:a] + (x.row.new or "") + t[max(a, b) :]
        assert np.frombuffer(bytes(x.ids), "<u4").tolist() == library.encode_ordinary(x.text)


def test_texts_in_blocks(vocabulary, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK", 20)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 30)
    texts = ["one  two   three'll do  it \n\n now " * 20, "x" * 100, "", " a" * 70]
    assert [np.frombuffer(x, "<u4").tolist() for x in vocabulary.ids(texts)] == [library.encode_ordinary(t) for t in texts]


def test_ranks_that_are_no_merges():
    single = b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256))
    line = lambda token, rank: base64.b64encode(token) + b" %d\n" % rank
    byte_bpe.Vocabulary(single + line(b"ab", 256) + line(b"abc", 257), "a")
    for more in (line(b"abc", 256), line(b"abc", 256) + line(b"ab", 257), line(b"ab", 3)):
        with pytest.raises(ValueError):
            byte_bpe.Vocabulary(single + more, "a")
    with pytest.raises(ValueError):
        byte_bpe.Vocabulary(single[:100], "a")
