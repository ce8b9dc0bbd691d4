"""Operators on whole tables against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from txloom.llm import hilbert, minhash, topk, url_filter, warc
from txloom.llm.components import components

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (1, 5)])
def test_curve_visits_neighbours(dims, bits):
    order = np.argsort(hilbert.curve(dims, bits))
    cells = np.stack([(order >> (bits * k)) & ((1 << bits) - 1) for k in range(dims)])
    assert (np.abs(np.diff(cells)).sum(0) == 1).all()


@pytest.mark.parametrize("exact", [True, False])
def test_shards_are_even_runs(spark, awkward, nothing, monkeypatch, exact):
    if not exact:
        monkeypatch.setattr(hilbert, "MAX_CLASSES", 1)
    dims = [F.col("source").isNull().cast("int"), hilbert.size_class(F.col("n_chars"))]
    placed = hilbert.shard(awkward, dims, [F.col("doc_id"), F.col("text")], shards=4).collect()
    assert len(placed) == awkward.count() and {r["_key_0"] for r in placed} == {"own"}
    slots = defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    order = sorted(placed, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in placed)
    assert hilbert.shard(nothing, dims, [F.col("doc_id")]).count() == 0


def test_cells_of_many_strings_are_exact(spark, monkeypatch):
    """Equal-depth cells of string and number columns, beyond MAX_CLASSES values as below."""
    rows = [("s%d" % (i * i % 311), i % 7 / 2) for i in range(500)] + [("s5", None)] * 300 + [(None, 1.5)] * 40
    df = spark.createDataFrame(rows, "source string, x double")
    for name, at in (("source", 0), ("x", 1)):
        values = sorted((r[at] for r in rows), key=lambda v: (v is not None, v))
        least = {v: values.index(v) * 16 // len(rows) for v in set(values)}
        for most in (1 << 16, 2):
            monkeypatch.setattr(hilbert, "MAX_CLASSES", most)
            found = hilbert._cell_of(df.withColumn("k", F.col(name)), "k", "cell", 4).collect()
            assert sorted((str(r[name]), r.cell) for r in found) == sorted((str(r[at]), least[r[at]]) for r in rows)


def test_written_shards_hold_all_rows(spark, awkward, tmp_path):
    placed = hilbert.shard(awkward, [hilbert.size_class(F.col("n_chars"))], [F.col("doc_id")], shards=3)
    hilbert.write_shards(placed, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 3


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("bucket,block,coordinate", [(16384, 1024, 0.6), (30, 7, 0.0), (30, 7, 2.0)])
def test_top_k_like_brute_force(spark, monkeypatch, bucket, block, coordinate):
    monkeypatch.setattr(topk, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "COORDINATE_FROM", coordinate)
    rng = np.random.default_rng(3)
    data = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 3])).tolist()) for i in range(150)]
    data += [(150 + i, data[7][1]) for i in range(40)]  # ties
    data += [(200, [0.0] * 6), (220, [0.0] * 6), (201, None), (202, [1.0, None]), (203, [float("nan")]), (204, [float("inf")]), (205, []), (206, [2.5])]
    vectors = topk.integers(vectors_of(spark, data), "vec_id", "embedding")
    found = topk.top_k(vectors, vectors.where("id % 20 = 0"), k=5)
    got = sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect()))
    good = {i: [int(np.floor(np.float32(x) * 64.0)) for x in v] for i, v in data if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q in (i for i in good if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    assert got == sorted(expected)


def test_top_k_without_rows(spark):
    few = topk.integers(vectors_of(spark, [(20, [1.0]), (None, [1.0])]), "vec_id", "embedding")
    assert topk.top_k(few, few.where("id % 20 = 0")).count() == 0
    none = few.limit(0)
    assert topk.top_k(none, none).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (20, 3)] + [(100, i) for i in range(101, 140)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def python_groups(rows, size, percent):
    sets = []
    for _, text in rows:
        w = [x for x in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\x0b", " ").split(" ") if x.strip("\t\n\r\x0c")]
        w = " ".join(w).split() if all(ord(c) < 128 for c in text or "") else w
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        least[find(i)].append(key)
    return [(key, len(sets[i]), min((k for k in least[find(i)] if k is not None), default=None)) for i, (key, _) in enumerate(rows)]


def test_near_duplicates_like_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 60))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 101 + 200, " ".join(copy)))
    # One passage in many texts, a chain whose ends differ, copies, short and empty texts.
    rows += [(400 + i, shared + " " + " ".join(rng.choice(vocabulary) for _ in range(40))) for i in range(15)]
    chain = [f"c{i}" for i in range(80)]
    rows += [(500 - i, " ".join(chain[i * 3 : i * 3 + 60])) for i in range(6)]
    rows += [(600, "One"), (601, "one"), (602, "one two"), (603, ""), (604, None), (605, " \t"), (606, "One"), (606, "One"), (None, "one"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("class", "n", "kept")})
    settings = minhash.Settings(shingle=3, percent=85, matches=36)
    got = minhash.near_duplicates(df, settings=settings)
    expected = python_groups(rows, 3, 85)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=key) == sorted(expected, key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.collect())


def test_near_duplicates_on_awkward_rows(awkward, nothing):
    found = minhash.near_duplicates(awkward).collect()
    assert len(found) == awkward.count()
    assert {r.component_id for r in found if r.doc_id in (7, 8)} == {7}
    assert minhash.near_duplicates(nothing).count() == 0


def test_url_parts_and_rules(spark):
    cases = {
        "https://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net": ("example.net", "", None, "allow"),
        "http://xexample.com/de/1": ("xexample.com", "/de/1", None, "allow"),
        "http://m.example.com/de/": ("m.example.com", "/de/", "example.com/de/", "block"),
        "http://a.org/fr/x://y": ("a.org", "/fr/x://y", "org/fr/", "allow"),
        "http://h.net/a": ("h.net", "/a", "net/", "block"),
        "nothing": ("", "", None, "allow"),
        "://?q": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(u, "own") for u in cases], "url string, host string")
    for r in url_filter.filter_urls(df, "url", RULES).collect():
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url]
    assert url_filter.filter_urls(df.limit(0), "url", RULES).count() == 0


def test_bad_templates_are_rejected(spark):
    s = url_filter.Settings(max_children=5)
    rows = [("h", f"/ads/{i}.html", 1) for i in range(30)] + [("h", f"/ads/{i}.html", None) for i in range(30, 60)]
    rows += [("h", f"/news/{i}", 0) for i in range(30)] + [("h", f"/mixed/{i}", i % 2) for i in range(30)]
    rows += [("h", f"/p/slug-{chr(97 + i)}{chr(98 + i)}", None) for i in range(20)] + [("g", "/ads/1.html", None), (None, None, None)]
    templates = url_filter.path_templates(spark.createDataFrame(rows, "host string, path string, label int"), s)
    by_shape = {(r.host, r.shape): r for r in templates.collect()}
    assert by_shape["h", "/ads/{n}.html"].rejected and by_shape["h", "/ads/{n}.html"].labelled == 30
    assert not by_shape["h", "/news/{n}"].rejected and not by_shape["h", "/mixed/{n}"].rejected
    assert not by_shape["g", "/ads/{n}.html"].rejected
    assert {r.template for k, r in by_shape.items() if k[1].startswith("/p/")} == {"/p/+"}


def test_hidden_labels_are_found_by_other_hosts(spark):
    """A fifth of the hosts show no label; their templates are judged by the rest."""
    bad = {"/ads/{n}": True, "/win/{n}.html": True, "/news/{n}": False, "/wiki/{n}.html": False}
    rows, truth = [], {}
    for h in range(20):
        host = f"{'www' if h % 2 else 'm'}.site{h // 2}.org"
        for template, is_bad in bad.items():
            truth[host, template] = is_bad
            paths = [template.replace("{n}", str(h * 10 + k)) for k in range(6)]
            rows += [(host, path, None if h % 5 == 0 else int(is_bad)) for path in paths]
    urls = spark.createDataFrame(rows, "host string, path string, label int")
    found = {(r.host, r.template): r for r in url_filter.shared_templates(urls).collect()}
    assert {k: r.rejected for k, r in found.items()} == truth
    own = {(r.host, r.template): r.rejected for r in url_filter.path_templates(urls).collect()}
    assert not any(own[f"m.site{h // 2}.org", "/ads/{n}"] for h in (0, 10))
    # m.site0.org shows no label, www.site0.org six bad ones, other domains 90.
    elsewhere = (90 + 2) / (90 + 4)
    assert found["m.site0.org", "/ads/{n}"].purity == pytest.approx((6 + 4 * elsewhere) / (6 + 4))
    assert url_filter.shared_templates(urls.limit(0)).count() == 0


def test_filtering_keeps_clashing_columns(spark, awkward):
    df = awkward.withColumn("url", F.concat(F.lit("http://a.net/"), "doc_id")).withColumn("_salt", F.lit("own"))
    rows = url_filter.filter_urls(df, "url", RULES).collect()
    assert len(rows) == awkward.count()
    assert all(r["_rejected"] == r["_shape"] == r["_salt"] == r["n"] == "own" for r in rows)


def test_like_branches_merge(spark):
    rows = [("h", f"/{lang}/{i}", None) for lang in ("en", "de", "fr") for i in range(20)]
    rows += [("h", f"/api/v{i}/call", None) for i in range(3)]
    templates = url_filter.path_templates(spark.createDataFrame(rows, "host string, path string, label int"))
    named = {r.shape: r.template for r in templates.collect()}
    assert named["/en/{n}"] == named["/de/{n}"] == named["/fr/{n}"] == "/+/{n}"
    assert named["/api/v{n}/call"].startswith("/api/")


def test_warc_records_are_linked(spark, tmp_path):
    html = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><p>One<br>two</p><script>x<1</script><!-- c --><p>é</p></body></html>"
    pages = spark.createDataFrame([(1, "http://h/1", html), (2, None, None), (3, "", ""), (3, "", "")], "page_id long, url string, html string")
    source = warc.responses(pages.withColumn("block", F.lit("own")), "2024-01-01T00:00:00Z")
    records = warc.derivatives(source, keep=["page_id"])
    rows = records.collect()
    assert len(rows) == 8
    first = {r.record_type: r for r in rows if r.page_id == 1}
    assert first["conversion"].block == "A & B\nOne\ntwo\né"
    assert first["conversion"].refers_to == first["metadata"].refers_to == source.where("page_id = 1").first().record_id
    assert f"conversion: {first['conversion'].record_id}" in first["metadata"].block
    assert "source-header: Content-Type: text/html" in first["metadata"].block
    assert all(r.content_length == len(r.block.encode()) for r in rows)
    assert {r.block for r in rows if r.page_id == 2 and r.record_type == "conversion"} == {""}
    assert not any("Target-URI" in r.headers for r in rows if r.page_id == 2)
    warc.write_warc(records, str(tmp_path / "warc"))
    import gzip

    data = b"".join(gzip.open(p).read() for p in (tmp_path / "warc").glob("*.gz")).decode()
    assert data.count("WARC/1.1\r\nWARC-Type: ") == 8 and data.endswith("\r\n\r\n")
    assert warc.derivatives(source.limit(0)).count() == 0


def python_templates(rows, s):
    """The tree of templates with plain loops: (host, shape) -> (template, labelled, bad)."""
    import re
    from collections import Counter

    def shape(path):
        parts = path.split("/")
        parts = parts[: s.depth + 1] + ["**"] if len(parts) > s.depth + 1 else parts
        uuid = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
        parts = [re.sub(rf"{uuid}|\b(?=[a-f]*[0-9])[0-9a-f]{{12,}}\b", "{x}", p, flags=re.I | re.A) for p in parts]
        return tuple(re.sub("[0-9]+", "{n}", p) for p in parts)

    trees = defaultdict(Counter)
    for host, path, label in rows:
        trees[host or "", shape(path or "")].update(n=1, bad=label == 1, good=label == 0)
    prefix = {key: "" for key in trees}
    for level in range(1, s.depth + 2):
        inner = [k for k in trees if len(k[1]) > level]
        segment = {k: k[1][level] for k in inner}
        each, node = Counter(), defaultdict(Counter)
        for k in inner:
            each[k[0], prefix[k], segment[k]] += trees[k]["n"]
        for (host, before, name), n in each.items():
            node[host, before][name] = n
        for k in inner:
            children = node[k[0], prefix[k]]
            if len(children) > s.max_children and children[segment[k]] < sum(children.values()) * s.rare_share:
                segment[k] = "*"
        branches = defaultdict(lambda: defaultdict(list))
        for k in inner:
            branches[k[0], prefix[k]][segment[k]].append(k)

        def spread(keys):
            out = Counter()
            for k in keys:
                out[k[1][level + 1] if len(k[1]) > level + 1 else ""] += trees[k]["n"]
            return out, sum(out.values())

        def rate(keys, name):
            return sum(trees[k][name] for k in keys) / sum(trees[k]["n"] for k in keys)

        for (_, _), own in branches.items():
            if len(own) < 2:
                continue
            every = [k for keys in own.values() for k in keys]
            pool, total = spread(every)
            for keys in own.values():
                here, n = spread(keys)
                distance = sum(max(0, here[x] / n - pool[x] / total) for x in here)
                if distance <= s.distance and all(abs(rate(keys, c) - rate(every, c)) <= s.label_gap for c in ("bad", "good")):
                    for k in keys:
                        segment[k] = "+"
        for k in inner:
            prefix[k] += "/" + segment[k]
    sums = defaultdict(Counter)
    for k, t in prefix.items():
        sums[k[0], t].update(labelled=trees[k]["bad"] + trees[k]["good"], bad=trees[k]["bad"])
    return {(k[0], "/".join(k[1])): (t, sums[k[0], t]["labelled"], sums[k[0], t]["bad"]) for k, t in prefix.items()}


def test_templates_like_plain_loops(spark):
    rng = random.Random(8)
    names = ["en", "de", "news", "item", "p", "x1", "00aa11bb22cc33dd", "a-b"]
    rows = []
    for _ in range(600):
        parts = [rng.choice(names) if rng.random() < 0.7 else f"s{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randint(0, 9))]
        rows.append((rng.choice(["h", "h", "g", "k", None]), "/".join(["", *parts, str(rng.randint(0, 99))]), rng.choice([0, 1, 1, None, None])))
    rows += [("g", "", None), ("g", None, 1)]
    s = url_filter.Settings(max_children=6, rare_share=0.05, distance=0.3, label_gap=0.3, depth=4)
    found = url_filter.path_templates(spark.createDataFrame(rows, "host string, path string, label int"), s).collect()
    expected = python_templates(rows, s)
    assert {(r.host, r.shape): (r.template, r.labelled) for r in found} == {k: v[:2] for k, v in expected.items()}
    for r in found:
        labelled, bad = expected[r.host, r.shape][1:]
        assert r.purity == pytest.approx((bad + 2.0) / (labelled + 4.0))
        assert r.rejected == (labelled >= 5 and (bad + 2.0) / (labelled + 4.0) >= 0.8)
