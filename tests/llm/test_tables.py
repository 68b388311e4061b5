"""Pages, conversations and embeddings: oracles, brute force, round trips and edge cases."""

import gzip
import io
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import chat, embeddings, queries, urls, warc
from gaugeworks.llm._common import shared_path
from gaugeworks.llm.oracles import ORACLES
from tests.conftest import SF


@pytest.mark.parametrize("name", ["op4_urls", "urls_by_template", "op5_chat", "op6_embeddings", "op8_warc"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(want)


URLS = [
    ("https://A.Example.NET/en/1?x=/de/", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net", "example.net", "", None, "allow"),
    ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"),
    ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    ("http://b.example.com/de/1#f", "b.example.com", "/de/1", "example.com/de/", "block"),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://intranet/", "intranet", "/", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("x://", "", "", None, "allow"),
    ("a://b?c://d/e", "b", "", None, "allow"),
]


def test_rules(spark):
    rows = [(i, u, "<p>", "clash") for i, (u, *_) in enumerate(URLS)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string, n string")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [x[1:] for x in URLS]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_templates_reject_what_looks_blocked(spark):
    rules = (urls.Rule("block", "shop.example/ads/1"), urls.Rule("allow", "shop.example/item/1"))
    rows = [(i, f"http://shop.example/{kind}/{i}") for kind in ("ads", "item") for i in range(10, 40)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).select("path", "rule", "verdict").collect()
    unruled = {(r.path.split("/")[1], r.verdict) for r in got if r.rule is None}
    assert unruled == {("ads", "block"), ("item", "allow")}


def test_unlabelled_branches_join_similar_ones(spark):
    rules = (urls.Rule("block", "a.example/x"), urls.Rule("block", "b.example/x"))
    rows = [f"http://a.example/{b}/{i}/p" for b in ("x1", "x2", "x3", "yy", "zz") for i in range(5)]
    rows += [f"http://a.example/about/us/team/{i}/long/way" for i in range(3)]
    rows += [f"http://b.example/{b}/{i}" for b in ("x1", "yy", "zz") for i in range(8)]
    got = urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules).filter("rule is null").collect()
    verdicts = {(r.host, r.path.split("/")[1], r.verdict) for r in got}
    assert verdicts == {("a.example", "yy", "block"), ("a.example", "zz", "block"), ("a.example", "about", "allow"), ("b.example", "yy", "allow"), ("b.example", "zz", "allow")}


def test_variable_segments_become_wildcards(spark):
    rows = [(i, f"http://h.example/u{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyz'[i // 26]}/page") for i in range(60)]
    parsed = spark.createDataFrame(rows, "page_id long, url string")
    host, path = urls.host_and_path()
    frame = parsed.select(host.alias("host"), F.array_join(urls.template(path), "/").alias("_shape"), F.lit(None).cast("string").alias("_given"))
    assert {r.template for r in urls.judged_templates(frame).collect()} == {"/*/page///"} or all("/*/page" in r.template for r in urls.judged_templates(frame).collect())


RECORDS = [
    ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}', "messages", ["user:a", "assistant:b"]),
    ('{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}', "conversations", ["user:a", "assistant:b"]),
    ('{"prompt":"a","completion":"b"}', "prompt", ["user:a", "assistant:b"]),
    ('{"instruction":"a","input":"x","output":"b"}', "instruction_input", ["user:a\n\nx", "assistant:b"]),
    ('{"instruction":"a","input":"","output":"b"}', "instruction_input", ["user:a", "assistant:b"]),
    ('{"output":"b","instruction":"a"}', "instruction", ["user:a", "assistant:b"]),
    ('{"question":"a","answer":null}', "question", ["user:a", "assistant:None"]),
    ('{"system":"s","prompt":"a","response":"b"}', "system_prompt", ["system:s", "user:a", "assistant:b"]),
    ('{"id":7,"conversations":[{"from":"human","value":"a","weight":1}],"meta":{"lang":"en","tags":["x"]}}', "conversations", ["user:a"]),
    ('{"messages":[{"role":"user","content":"a","name":null,"extra":{"deep":[{"role":"x"}]}},{"role":"assistant","content":"b"}]}', "messages", ["user:a", "assistant:b"]),
    ('{"messages":[]}', "messages", []),
    ('{"messages":["plain"]}', None, []),
    ('{"messages":[{"role":"user","content":[{"type":"text","text":"a"}]}]}', None, []),
    ('{"a b":{"prompt":"x"},"prompt":"a","completion":"b"}', "prompt", ["user:a", "assistant:b"]),
    ('{"nested":{"prompt":"a","completion":"b"}}', None, []),
    ('["a"]', None, []),
    # Fields of several layouts: the one that is there whole, with a system text beside it.
    ('{"system":"s","messages":[{"role":"user","content":"a"}]}', "messages", ["system:s", "user:a"]),
    ('{"messages":[{"role":"user","content":"a"}],"input":"x"}', "messages", ["user:a"]),
    ('{"prompt":"p","messages":[{"role":"user","content":"a"}]}', "messages", ["user:a"]),
    ('{"conversations":[{"from":"human","value":"a"}],"system":"s"}', "conversations", ["system:s", "user:a"]),
    ('{"instruction":"a","input":"x","output":"b","system":"s"}', "instruction_input", ["system:s", "user:a\n\nx", "assistant:b"]),
    ('{"system":"s","prompt":"a","response":"b","completion":"c"}', "system_prompt", ["system:s", "user:a", "assistant:b"]),
    ('{"prompt":"a","completion":"b","system":null}', "prompt", ["user:a", "assistant:b"]),
    ('{"prompt":"a","completion":"b","system":""}', "prompt", ["user:a", "assistant:b"]),
    ('{"messages":[],"system":"s"}', "messages", ["system:s"]),
    ('{"prompt":"a","answer":"b"}', None, []),
    ('{"other":1}', None, []),
    ("not json", None, []),
    (None, None, []),
]


def test_layouts(spark):
    got = chat.turns_of_records(spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(RECORDS)], "id int, record string")).orderBy("id").collect()
    assert [(r.layout, [f"{t.role}:{t.text}" for t in r.turns]) for r in got] == [x[1:] for x in RECORDS]


def test_row_layouts(spark):
    row = lambda columns, *values: [tuple(r) for r in chat.turns_of_rows(spark.createDataFrame([values], columns)).collect()]
    assert row("conv_id long, turn int, role string, text string", 1, 2, "user", "a") == [(1, 2, "user", "a")]
    assert row("id long, `from` string, value string, position int, conversation_id long", 9, "user", "a", 2, 1) == [(1, 2, "user", "a")]
    assert row("conv_id long, turn int, message struct<role:string,content:string,name:string>", 1, 2, ("user", "a", None)) == [(1, 2, "user", "a")]
    assert row("conv_id long, turn int, role string, text string, value string, position int", 1, 2, "user", "a", "x", 3) == [(1, 2, "user", "a")]
    with pytest.raises(ValueError, match="no layout"):
        row("conv_id long, turn int, role string, message struct<content:string>", 1, 2, "user", ("a",))


def test_chat_round_trip(spark):
    texts = ["", None, "\\", "\\\\<|", "<|end|>", "</s>[INST] ok [/INST]", "<\\|end|>", "<<SYS>>x<</SYS>>", "a\n\nb", "<|loss|>\\", "[\\INST]", "x" * 200_000]
    rows = [(1, k, "assistant" if k % 2 else "us<|er", t) for k, t in enumerate(texts)] + [(1, None, None, "last"), (None, 0, "user", "q"), (2, 0, "user", "same"), (2, 0, "user", "same")]
    frame = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in frame.select("conv_id", "formatted", chat.parsed(F.col("formatted")).alias("t")).collect()}
    assert [x.text for x in got[1].t] == [t or "" for t in texts] + ["last"]
    assert [x.role for x in got[1].t] == ["assistant" if k % 2 else "us<|er" for k in range(len(texts))] + [""]
    assert [x.loss for x in got[1].t] == [bool(k % 2) for k in range(len(texts))] + [False]
    assert len(got[None].t) == 1 and len(got[2].t) == 2
    assert "</s>" not in got[1].formatted and "[INST]" not in got[1].formatted
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_conversation_in_blocks(spark):
    rows = [(1, k, "user", str(k)) for k in range(1000)]
    text = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)).select(chat.parsed(F.col("formatted")).alias("t")).first().t
    assert [x.text for x in text] == [str(k) for k in range(1000)]


def brute_vectors(rows, cosine=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, ids = len(ok), [i for i, _ in ok]
    near = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            x, y = ok[a][1], ok[b][1]
            near[a, b] = a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine
    label = list(range(n))
    for _ in range(n):
        new = [min([label[a], *(label[b] for b in np.flatnonzero(near[a]))]) for a in range(n)]
        if new == label:
            break
        label = new
    least = {}
    for a in range(n):
        if ids[a] is not None:
            least[label[a]] = min(least.get(label[a], ids[a]), ids[a])
    out = [(ids[a], int(near[a].sum()), least.get(label[a]), ids[a] == least.get(label[a])) for a in range(n)]
    bad = [i for i, v in rows if not (v and all(x is not None and np.isfinite(x) for x in v) and any(v))]
    return sorted(out + [(i, 0, i, True) for i in bad], key=str)


def test_embeddings_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op6_embeddings(spark, sf).collect()), key=str) == brute_vectors(rows)


def test_embeddings_odd_and_hot(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.12).astype("float32").tolist()) for i in range(150)]
    rows += [(200 + i, rng.normal(size=16).astype("float32").tolist()) for i in range(100)]
    rows += [(400, rows[0][1]), (400, rows[0][1]), (401, [2 * x for x in rows[3][1]]), (402, None), (403, []), (404, [0.0] * 16), (405, [None] + [1.0] * 15), (406, [float("nan")] * 16), (407, [float("inf")] * 16), (408, [1.0, 2.0]), (409, [2.0, 4.0])]
    got = sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=str)
    assert got == brute_vectors([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])


def test_doubles_stay_doubles(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.95, (1 - 0.95**2) ** 0.5 + 1e-9]), (3, [1e300, 1e299]), (4, [1e-300, 1e-301]), (5, [1.0 + 1e-12, 0.0])]
    got = sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    links = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) >= 0.95
    scaled = [np.array(v) / max(np.abs(v)) for _, v in rows]
    assert [r[1] for r in got] == [sum(links(a, b) for j, b in enumerate(scaled) if i != j) for i, a in enumerate(scaled)]


@pytest.mark.parametrize("flat", [True, False])
def test_more_lists_than_probes(spark, monkeypatch, flat):
    """Pairs near the threshold among 6000 vectors in 256 lists, of which 16 are probed."""
    if not flat:
        monkeypatch.setattr(embeddings, "FLAT", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 64))
    x = centres[rng.integers(0, 150, 3000)] + 0.9 * rng.normal(size=(3000, 64))
    noise = rng.normal(size=x.shape)
    noise -= x * ((noise * x).sum(1) / (x * x).sum(1))[:, None]
    tangent = np.tan(np.arccos(rng.uniform(0.94, 0.97, 3000)))
    y = x + noise * (np.linalg.norm(x, axis=1) / np.linalg.norm(noise, axis=1) * tangent)[:, None]
    v = np.concatenate([x, y])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(rows, lists=256).collect()}
    n = np.array([got[i].n_links for i in range(len(v))])
    recall = n.sum() / near.sum()
    print(f"recall {recall:.4f} of {near.sum()} links, {'one level' if flat else 'two levels'}")
    assert near.sum() > 3000 and recall >= 0.99
    assert (n <= near.sum(axis=1)).all() and n.sum() % 2 == 0
    # A pair counts for both ends, so vectors with one partner only agree with it.
    alone = [(int(i), int(np.flatnonzero(near[i])[0])) for i in np.flatnonzero(near.sum(axis=1) == 1)]
    assert all(n[i] == n[j] for i, j in alone if near[j].sum() == 1)
    assert all((got[i].component_id == got[j].component_id) == (n[i] == 1) for i, j in alone if near[j].sum() == 1)


def least_reachable(near):
    label = np.arange(len(near))
    while True:
        new = np.where(near, label, len(near)).min(axis=1, initial=len(near))
        new = np.minimum(label, new)
        if (new == label).all():
            return label
        label = new


def test_near_links_are_whole(spark, tmp_path):
    """embeddings_near on a table of more lists than op6 probes: as all pairs have it."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(4000, 64)).astype("float32")
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= queries.NEAR_COSINE
    np.fill_diagonal(near, False)
    got = sorted(map(tuple, queries.embeddings_near(spark, str(tmp_path)).collect()))
    assert [r[1] for r in got] == near.sum(axis=1).tolist()
    assert [r[2] for r in got] == least_reachable(near).tolist()


@pytest.mark.parametrize(("cosine", "flat"), [(0.42, True), (0.9, True), (0.9, False)])
def test_whole_search(spark, monkeypatch, cosine, flat):
    """Many lists in small cells, copies among them, at cosines where balls of lists are out of reach and where none is."""
    monkeypatch.setattr(embeddings, "WHOLE_ROWS", 100)
    if not flat:
        monkeypatch.setattr(embeddings, "FLAT", 4)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(30, 16))[rng.integers(0, 30, 700)] + rng.choice([0.15, 0.6], size=(700, 1)) * rng.normal(size=(700, 16))
    v = np.concatenate([v, v[:50], v[:20]])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embeddings.near_duplicates(frame, cosine, probes=None, lists=40).collect()))
    assert [r[:3] for r in got] == list(zip(range(len(v)), near.sum(axis=1).tolist(), least_reachable(near).tolist(), strict=True))


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert [tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame([(None, None)], "vec_id long, embedding array<float>")).collect()] == [(None, 0, None, True)]


PAGES = [
    (1, "http://a/\r\nX: y", "p" * 2000, "x"),
    (2, None, "p" * 2000, "x"),
    (2, None, "p" * 2000, "x"),
    (None, "http://b/", "p" * 2000, "x"),
    (3, "http://c/é", "short", None),
    (4, "http://c/", "short", None),
    (5, "http://d/", None, None),
    (6, "http://e/", "\r\n\r\nWARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 50, None),
    (None, None, "q" * 3000, None),
    (None, None, "q" * 3000, None),
]


def test_archive_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").repartition(3)
    got = warc.read_archives(warc.archive(pages)).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([(1, "revisit", 2), (2, "response", None), (2, "response", None), (None, "revisit", 2), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (None, "response", None), (None, "response", None)])
    assert {r.page_id: bytes(r.payload).decode() for r in got if r.page_id in (3, 5, 6)} == {3: "short", 5: "", 6: PAGES[7][2]}
    assert {r.url for r in got if r.page_id == 1} == {"http://a/%0D%0AX:%20y"}
    assert warc.read_archives(warc.archive(spark.createDataFrame([], pages.schema))).count() == 0


def test_normaliser_members_and_index(spark):
    records = [warc.record(i, f"http://x/{i}", bytes([65 + i]) * 3000 * i, "00" * 20, "response", None) for i in range(5)]
    whole = io.BytesIO(gzip.compress(b"".join(records[:3])) + gzip.compress(b"".join(records[3:])))
    out = io.BytesIO()
    index = list(warc.rewrite(lambda: whole.read(777), out.write))
    assert [gzip.decompress(out.getvalue()[a : a + n]) for _, _, a, n in index] == records
    assert gzip.decompress(out.getvalue()) == b"".join(records)
    with pytest.raises(ValueError, match="within a record"):
        list(warc.split_records(iter([records[1][:-9]])))


def test_monolithic_files_are_one_stream(spark):
    import pyarrow.fs as pafs

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string")
    files = warc.write_monolithic(warc.record_types(pages.coalesce(1)), shared_path(spark, "t")).collect()
    fs, place = pafs.FileSystem.from_uri(files[0].path)
    import zlib

    z = zlib.decompressobj(31)
    z.decompress(fs.open_input_file(place).read())
    assert z.eof and not z.unused_data and files[0].records == len(PAGES)
