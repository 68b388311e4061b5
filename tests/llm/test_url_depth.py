"""Templates of paths with more than three segments."""

from pyspark.sql import functions as F

from gaugeworks.llm import urls

SCHEMA = "page_id long, url string"


def verdicts(spark, paths, blocked, allowed=()):
    rules = (*(urls.Rule("block", f"deep.example{p}") for p in blocked), *(urls.Rule("allow", f"deep.example{p}") for p in allowed))
    pages = spark.createDataFrame([(i, f"http://deep.example{p}") for i, p in enumerate(paths)], SCHEMA)
    return {r.path: r.verdict for r in urls.judge(pages, rules).collect() if r.rule is None}


def test_variable_fourth_segment(spark):
    names = [f"{chr(97 + i // 6)}{chr(97 + i % 6)}" for i in range(60)]
    paths = [f"/a/b/c/{n}" for n in names] + [f"/x/y/z/{n}/w/{n}" for n in names]
    got = verdicts(spark, paths, [f"/a/b/c/{n}" for n in names[:40]], [f"/x/y/z/{n}/" for n in names[:40]])
    assert {got[f"/a/b/c/{n}"] for n in names[40:]} == {"block"}
    assert {got[f"/x/y/z/{n}/w/{n}"] for n in names[40:]} == {"allow"}


def test_every_shape_has_one_template(spark):
    paths = ["/" + "/".join("abcdefgh"[:k]) for k in range(9)] + ["/a/b/c/x", "/a/b/c/", "/a/b/c//x", "/a/b/c/d/e/f/x/y", "/" + "s/" * 30]
    host, path = urls.host_and_path()
    frame = spark.createDataFrame([(i, f"http://deep.example{p}") for i, p in enumerate(paths)], SCHEMA)
    frame = frame.select(host.alias("host"), F.array_join(urls.template(path), "/").alias("_shape"), F.lit(None).cast("string").alias("_given"))
    got = urls.judged_templates(frame).collect()
    assert len(got) == len({r.shape for r in got}) == frame.select("_shape").distinct().count()


def plain_tree(shapes):
    """{shape: template} of one unlabelled host, level by level, in plain loops."""
    rows = {s: (s.split("/"), []) for s in shapes}
    open_, level = set(rows), 0
    while True:
        at = lambda s, k: rows[s][0][k] if k < len(rows[s][0]) else ""
        if level >= urls.LEVELS:
            nodes = {}
            for s in open_:
                nodes.setdefault(tuple(rows[s][1]), []).append(s)
            open_ = {s for n in nodes.values() for s in n if len(n) > 1 and max(len(rows[x][0]) for x in n) > level}
        if not open_:
            return {s: "/".join(["", *t, *segments[len(t) :]]) for s, (segments, t) in rows.items()}
        nodes = {}
        for s in open_:
            nodes.setdefault(tuple(rows[s][1]), {}).setdefault(at(s, level), []).append(s)
        for children in nodes.values():
            total = sum(map(len, children.values()))
            for name, held in children.items():
                token = "*" if len(children) > urls.VARIABLE and len(held) * 20 < total else name
                for s in held:
                    rows[s][1].append(token)
        level += 1


def shape_frame(spark, shapes):
    return spark.createDataFrame([("h", s, None) for s in shapes], "host string, _shape string, _given string")


def test_templates_equal_a_plain_tree(spark):
    import random

    rng = random.Random(3)
    shapes = {"/".join(rng.choice("abc") if k < 6 else "k" for k in range(rng.randrange(1, 12))) for _ in range(300)}
    shapes |= {f"p/q/r/s/t/{i}x/u/v" for i in map(str, range(40))} | {"/".join(["z"] * 40), "/".join(["z"] * 39 + ["y"]), "/".join(["z"] * 30), "z/z/z//"}
    got = {r.shape: r.template for r in urls.judged_templates(shape_frame(spark, shapes)).collect()}
    want = plain_tree(shapes)
    # A path that ends before a level counts as an empty segment there.
    assert {s: t.rstrip("/") for s, t in got.items()} == {s: t.rstrip("/") for s, t in want.items()}


def test_long_shared_paths_take_few_rounds(spark, monkeypatch):
    rounds, grown = [], urls._grown
    monkeypatch.setattr(urls, "_grown", lambda tree, level: rounds.append(1) or grown(tree, level))
    trap = "/".join(f"s{chr(97 + i % 26)}" for i in range(500))
    got = urls.judged_templates(shape_frame(spark, [trap, f"{trap}/a", f"{trap}/b", "x"])).collect()
    assert len(got) == 4 and len(rounds) <= urls.LEVELS + 3
