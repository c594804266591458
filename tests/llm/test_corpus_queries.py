import duckdb
import pytest

import __spark_entry__ as entry
from coilwave.llm import chat, queries, url_filter

TABLES = ("documents", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_same_rows_as_sql(spark, name, folder):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = queries.QUERIES[name](spark, folder)
    cur = db.execute(queries.ORACLE[name])
    names = [c[0] for c in cur.description]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(cur.fetchall(), key=key)


def test_all_eleven_are_registered():
    names = entry.queries()
    assert "pipeline" in names and {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names}


def test_chat_round_trip(spark):
    odd = ["", "\\", "<|im_end|>", "\\<|im_end|>\n", "<\\|", "a\nb", "\\n", "日本<|im_start|>user\nhi", "\\\\<|"]
    rows = [(i, t, role, text) for i, text in enumerate(odd) for t, role in enumerate(("user", "assistant", text or "tool"))] + [(None, None, None, None), (99, 0, "user", "q"), (99, 1, "assistant", "a"), (99, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    from pyspark.sql import functions as F

    made = chat.format_chats(chat.as_records(df)).select("row.conv_id", "turns", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("mask")).alias("loss"))
    for r in made.collect():
        assert r.turns == r.back
        own = [(t or 0, role or "", x or "") for c, t, role, x in rows if c == r.conv_id]
        assert [(t.role, t.text) for t in r.back] == [x[1:] for x in sorted(own)]
        assert r.loss == "".join(x[2] for x in sorted(own) if x[1] == "assistant")


def test_conversations_larger_than_a_variant(spark, tmp_path):
    import hashlib

    from pyspark.sql import functions as F

    n, size = 10, 14_000_000
    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    spark.range(n).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.repeat(F.col("id").cast("string"), size).alias("text")).write.parquet(f"{tmp_path}/conversations.parquet")
    r = queries.op8_chat_formatting(spark, str(tmp_path)).where("conv_id = 5").first()
    turns, loss = hashlib.sha256(), hashlib.sha256()
    for i in range(n):
        turns.update(f"{('user', 'assistant')[i % 2]}\n{str(i) * size}\n".encode())
        loss.update((str(i) * size).encode() if i % 2 else b"")
    marks = sum(len(chat.START + x + "\n" + chat.END) for x in ("user", "assistant")) * n // 2
    assert tuple(r) == (5, n, turns.hexdigest(), n // 2 * size, loss.hexdigest(), n * size + marks)


def test_records_too_large_to_read_are_not_lost(spark):
    record = two_halves(140_000_000)
    with pytest.raises(Exception, match="(?i)variant|malformed|size"):
        chat.canonical(spark.range(1).select(record.alias("record"))).select("turns").collect()


def two_halves(size):
    from pyspark.sql import functions as F

    return F.concat(F.lit('{"prompt": "'), F.repeat(F.lit("a"), size // 2), F.lit('", "completion": "'), F.repeat(F.lit("a"), size // 2), F.lit('"}'))


def test_layouts(spark):
    records = [
        '{"prompt": "p", "completion": "c"}', '{"question": "p", "answer": "c"}', '{"instruction": "p", "input": "", "output": "c"}',
        '{"messages": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "c"}]}',
        '{"conversations": [{"from": "human", "value": "p"}, {"from": "gpt", "value": "c"}]}', '{"response": "c", "prompt": "p"}',
    ]
    df = spark.createDataFrame([(r,) for r in [*records, None, "no json", '{"other": 1}', "{}"]], "record string")
    got = [r.turns and [tuple(t) for t in r.turns] for r in chat.canonical(df).collect()]
    assert got == [[("user", "p"), ("assistant", "c")]] * len(records) + [None] * 4


def test_fields_beside_a_layout(spark):
    records = ['{"id": 3, "prompt": "p", "completion": "c"}', '{"messages": [{"role": "user", "content": "p", "name": "x"}, {"role": "assistant", "content": "c"}], "source": "s"}', '{"prompt": "p", "completion": "c", "context": "not to be lost"}']
    df = spark.createDataFrame([(r,) for r in records], "record string")
    got = [r.turns and [tuple(t) for t in r.turns] for r in chat.canonical(df).collect()]
    assert got == [[("user", "p"), ("assistant", "c")]] * 2 + [None]


def test_layouts_that_conversations_are_dealt_to(spark, small):
    """The table's conversations meet most layouts, and large conversations turn by turn give the same."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = [(-5, 0, "human", "q"), (-5, 1, "gpt", "a"), (-6, 0, "system", ""), (-6, 1, "user", "u\\n"), (-6, 2, "assistant", None), (None, 0, "user", "\u0000\\\""), (None, 1, "assistant", "b"), (-7, 0, "assistant", "alone")]
    rows = rows.unionByName(spark.createDataFrame(odd, rows.schema)).cache()
    records = chat.as_records(rows)
    prints = records.select(F.array_join(F.array_sort(chat.field_paths(F.schema_of_variant(F.parse_json("record")))), ",").alias("p")).groupBy("p").count().collect()
    assert {r.p for r in prints} <= set(chat.LAYOUTS) and len(prints) >= 5

    def strings(together):
        made = chat.format_turns(rows, together).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("mask")))
        # of large conversations turn is the row's own number, of others the place
        return sorted((str(r.conv_id), r.formatted, r.loss) for r in made.collect())

    whole = strings(1 << 30)
    assert whole == strings(0) == strings(300) and len(whole) == rows.count()
    assert [(f, x) for c, f, x in whole if c == "-7"] == [("<|im_start|>assistant\nalone<|im_end|>\n", "alone")]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/7?x=/en/", "https://example.net/de/81#f", "x://y.org/es/", "http://host.com", "http://h.com?u=http://a/b", "ftp://com/en/", "http://b.de\n/x/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge_urls(pages, queries.URL_RULES).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, got[0][3])
    assert got[3][:3] == ("a.example.com", "/en/7", "example.com/en/7") and got[3][3] == "allow"
    assert got[4][:4] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert got[5][2:] == ("org/es/", "block") and got[6][:3] == ("host.com", "", None) and got[7][:2] == ("h.com", "") and got[8][2] == "com/en/"
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_domains_and_suffixes(spark):
    hosts = ["", "com", "a.com", "b.a.com", "a.co.uk", "x.a.co.uk", "co.uk", "1.2.3.4", "1.2.3.4:80", "u:p@b.a.com:8080", "[::1]:80"]
    table = spark.createDataFrame([("co.uk",), ("com",), ("uk",)], "suffix string")
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: (r.domain, r.suffix) for r in url_filter.registered_domain(df, table).collect()}
    want = [("", ""), ("com", "com"), ("a.com", "com"), ("a.com", "com"), ("a.co.uk", "co.uk"), ("a.co.uk", "co.uk"), ("co.uk", "co.uk"), ("1.2.3.4", ""), ("1.2.3.4", ""), ("a.com", "com"), ("[::1]", "")]
    assert got == dict(zip(hosts, want, strict=True))
    assert {r.host: r.domain for r in url_filter.registered_domain(df).collect()}["x.a.co.uk"] == "co.uk"


def test_pages_with_nulls_and_clashing_columns(spark):
    rows = [(None, "http://a.com/en/1", "x"), (None, None, "x"), (1, "http://a.com/q", None), (1, "http://a.com/q", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.selectExpr("*", *[f"1 AS {c}" for c in ("host", "path", "rule", "said", "bound", "domain", "suffix", "n", "x")])
    got = url_filter.judge_urls(pages, queries.URL_RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted((str(r.page_id), r.host, r.path) for r in got.collect()) == [("1", "a.com", "/q"), ("1", "a.com", "/q"), ("None", "", ""), ("None", "a.com", "/en/1")]


def test_roles_of_messages_stay_and_odd_conversations(spark):
    rows = [(1, 0, "human", "q"), (1, 1, "gpt", "a"), (1, 2, None, None), (None, None, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS record", "2 AS row", "3 AS turns", "4 AS mask", "5 AS v")
    from pyspark.sql import functions as F

    made = chat.format_turns(df)
    back = made.select("conv_id", F.element_at(chat.read_back(F.col("formatted")), 1).alias("t"), chat.loss_text(F.col("formatted"), F.col("mask")).alias("loss"))
    assert sorted((str(r.conv_id), r.t.role, r.t.text, r.loss) for r in back.collect()) == [("1", "", "", ""), ("1", "gpt", "a", ""), ("1", "human", "q", ""), ("None", "assistant", "b", "b")]
    assert chat.format_turns(df.limit(0)).count() == 0 and chat.format_chats(chat.as_records(df.limit(0))).count() == 0
    extra = spark.createDataFrame([('{"question": "p", "answer": "c"}', 1, 2)], "record string, row int, print int")
    assert chat.format_chats(extra).first().row.asDict() == {"record": '{"question": "p", "answer": "c"}', "row": 1, "print": 2}


def test_reputation_shrinks(spark):
    rows = [(f"h{i}.bad.com", 1) for i in range(30)] * 3 + [(f"g{i}.good.com", 0) for i in range(30)] * 3 + [("new.bad.com", None), ("new.good.com", None), ("far.net", None)]
    got = {r.host: r for r in url_filter.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    mean = lambda h: got[h].post_a / (got[h].post_a + got[h].post_b)
    assert mean("h1.bad.com") > mean("new.bad.com") > mean("far.net") > mean("new.good.com") > mean("g1.good.com")


def test_pipeline_against_its_parts(spark, small):
    import brute
    import corpus_pipeline as c
    from coilwave.llm import quality_rules

    assert c.ORACLE_SQL is None and [n for n, _ in c.STAGES][0] == "quality_rules"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.row.doc_id for r in quality_rules.judge(docs, "doc_id").where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    assert {r.doc_id for r in c.keep_good(spark, docs, small).collect()} == kept
    texts = {k: texts[k] for k, _, least in brute.jaccard_components(sorted(texts.items())) if k == least}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = {r[0] for r in brute.contaminated(sorted(texts.items()), items) if not r[-1]}
    got = c.run(spark, small).collect()
    assert {r.doc_id for r in got} <= clean
    assert all((r.size, r.text_crc32) == brute.size_and_crc(texts[r.doc_id]) for r in got)
    assert {len([1 for r in got if r.doc_id == k]) for k in clean} <= {0, 1, 2} and len({r.doc_id for r in got}) > 0.6 * len(clean)


@pytest.mark.parametrize("hosts", [1, 3, 10])
def test_pages_of_hot_hosts_stay_where_they_are(spark, monkeypatch, hosts):
    """However many hosts are broadcast: each page keeps its own host's verdict, repeated rows too."""
    urls = ["http://a.net/de/8/x"] * 3 + ["http://a.net/q"] * 9 + ["http://bad.com/en/1"] * 6 + ["http://bad.com/z"] * 2 + [None, "no host"] + [f"http://h{i}.org/{i}" for i in range(5)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string")
    want = sorted((tuple(r) for r in url_filter.judge_urls(pages, queries.URL_RULES).collect()), key=str)
    monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", hosts)
    assert sorted((tuple(r) for r in url_filter.judge_urls(pages, queries.URL_RULES).collect()), key=str) == want and len(want) == len(urls) + 1
    monkeypatch.setattr(url_filter, "HOST_BYTES", 6)
    assert sorted((tuple(r) for r in url_filter.judge_urls(pages, queries.URL_RULES).collect()), key=str) == want
