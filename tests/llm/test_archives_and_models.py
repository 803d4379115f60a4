"""WARC packages, the URL filter, the classifiers and the pipeline."""

import base64
import hashlib
import io
import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import queries, quality, toxicity, url_filter, warc_zip
from weft.llm._features import Beginnings, Indicators, in_fold, shape
from weft.llm.queries import RULES

SF = "/root/testdata/sf0.01"
PAGES = "page_id bigint, url string, html string, kind string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)


# -- archives ------------------------------------------------------------------------------------


def plain_archive(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= least and (h or "") in first and first[h or ""] != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    return sorted(out, key=repr)


ROWS = [(i, f"http://a.example/{i}", h) for i, h in enumerate(["<p>x</p>", "", None, "<p>x</p>", "é" * 3000, "日本", "<p>x</p>", "\r\n\r\n", "a\x00b"])] + [
    (50, None, "only"), (51, "http://b\r\nX: y/", "two lines"), (None, "http://c", "only"), (None, "http://d", "nobody else"), (3, "http://e", "<p>x</p>"), (0, "http://e", "<p>x</p>"), (60, "http://big", "z" * 300_000),
]


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, least):
    assert sorted((tuple(r) for r in warc_zip.archive(pages(spark, ROWS), least).collect()), key=repr) == plain_archive(ROWS, least)


def test_archive_of_nothing(spark):
    assert warc_zip.archive(pages(spark, [])).count() == 0


def test_packages_are_plain_zip_files_with_whole_payloads(spark, tmp_path):
    folder = f"file://{tmp_path}"
    packages = warc_zip.write(warc_zip.with_revisits(pages(spark, ROWS)), folder)
    assert packages.agg(F.sum("records")).first()[0] == len(ROWS)
    for r in packages.collect():
        with zipfile.ZipFile(r.path.removeprefix("file://")) as z:
            assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    got = warc_zip.read(spark, packages, with_payload=True).where("record_type = 'response'").collect()
    expected = {(i, h or "") for i, _, h in ROWS if ("response" in {r[3] for r in plain_archive(ROWS) if r[0] == i})}
    assert {(r.page_id, r.payload.decode()) for r in got} <= expected and len({r.payload for r in got}) == len({h or "" for _, _, h in ROWS})


def other_package(path, *, index, lengths=True, gz=False, classic=False, plain=False):
    """A package as others write them: two archives, ids of their own, and a CDX or CDXJ index."""
    import gzip

    records, lines = {"a": [], "b": []}, []
    for archive, url, payload in (("a", "http://x.example/1", b"one"), ("a", "http://x.example/2", "zwei é".encode()), ("b", "http://y.example/3", b"")):
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + payload
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{len(lines)}>\r\nWARC-Target-URI: {url}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
        data = head.encode() + http + b"\r\n\r\n"
        data = data if plain else gzip.compress(data)
        offset = sum(map(len, records[archive]))
        name = f"{archive}.warc" if plain else f"{archive}.warc.gz"
        records[archive].append(data)
        size = str(len(data))
        lines.append(f"example,x)/ 2024 {url} text/html 200 {digest} - - {size if lengths else '-'} {offset} {name}" if classic else f"example,x)/ 2024 {json.dumps({'url': url, 'offset': str(offset), 'filename': name} | ({'length': size} if lengths else {}))}")
    text = (" CDX N b a m s k r M S V g\n" if classic else "!meta {}\n") + "\n".join(lines) + "\n"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for archive, data in records.items():
            z.writestr(f"archive/{archive}.warc" + ("" if plain else ".gz"), b"".join(data))
        half = text.encode()
        z.writestr(index, gzip.compress(half[:20]) + gzip.compress(half[20:]) if gz else half)
        z.writestr("pages/pages.jsonl", "{}")
        z.writestr("datapackage.json", "{}")


@pytest.mark.parametrize(
    "kind",
    [{"index": "indexes/index.cdxj"}, {"index": "indexes/index.cdx", "classic": True}, {"index": "indexes/index.cdx.gz", "gz": True, "classic": True}, {"index": "indexes/i.cdxj.gz", "gz": True, "lengths": False}, {"index": "indexes/index.cdxj", "plain": True, "lengths": False}],
)
def test_packages_of_other_writers(spark, tmp_path, kind):
    path = str(tmp_path / "other.wacz")
    other_package(path, **kind)
    found = warc_zip.read(spark, spark.createDataFrame([(f"file://{path}",)], "path string"), with_payload=True).collect()
    assert sorted((r.url, r.payload, r.payload_bytes, r.record_type, r.page_id) for r in found) == [
        ("http://x.example/1", b"one", 3, "response", None), ("http://x.example/2", "zwei é".encode(), 7, "response", None), ("http://y.example/3", b"", 0, "response", None)
    ]


def test_archives_without_index_and_lines_without_archive(tmp_path):
    path = str(tmp_path / "p.wacz")
    line = json.dumps({"offset": "0", "length": "3", "filename": "b.warc.gz"})
    for names, text in ((["archive/a.warc.gz", "archive/b.warc.gz"], line), (["archive/a.warc.gz"], line), (["archive/a.warc.gz"], "")):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
            for n in names:
                z.writestr(n, b"abc")
            z.writestr("indexes/index.cdxj", f"k 2024 {text}\n" if text else "")
        with pytest.raises(ValueError):
            list(warc_zip.index_of(path))


def test_names_in_code_page_437(tmp_path):
    path = str(tmp_path / "p.wacz")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("notes/a.txt", b"x")
        z.writestr("archive/data.warc.gz", b"")
    data = open(path, "rb").read().replace(b"notes/a.txt", b"notes/\x81.txt")
    assert [m.name for m in warc_zip.directory(File(data), len(data))] == ["notes/ü.txt", "archive/data.warc.gz"]


class File(io.BytesIO):
    def read_at(self, size, at):
        return self.getvalue()[at : at + size]


def test_zip64_directory():
    """A package whose end record and entries hold their values in ZIP64 fields only."""
    full, name, data = 0xFFFFFFFF, b"archive/data.warc.gz", b"records"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, full, full, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(data), len(data))
    extra = struct.pack("<HHB", 0x5455, 1, 0) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, full, full, len(name), len(extra), 4, 0, 0, 0, full) + name + extra + b"note"
    at = len(local) + len(data)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\6\7", 0, at + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, full, full, 0)
    file = File(local + data + central + end64 + locator + end)
    member, = warc_zip.directory(file, len(file.getvalue()))
    assert (member.name, member.size, member.method, member.header) == (name.decode(), len(data), 0, 0)
    assert file.read_at(member.size, warc_zip.data_start(file, member)) == data


def test_compressed_members_and_broken_files_are_refused():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "x" * 1000)
    file = File(buffer.getvalue())
    with pytest.raises(ValueError):
        warc_zip.data_start(file, warc_zip.directory(file, len(buffer.getvalue()))[0])
    with pytest.raises(ValueError):
        warc_zip.directory(File(b"nothing"), 7)
    wrong = warc_zip.record(1, "u", b"payload", "A" * 32, "response", None)
    with pytest.raises(ValueError):
        warc_zip.parse(wrong)


# -- URLs ----------------------------------------------------------------------------------------

URLS = {
    None: ("", "", None), "": ("", "", None), "no scheme/path": ("", "", None), "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/"),
    "https://example.net/EN/": ("example.net", "/EN/", "net/"), "https://notexample.net/en/": ("notexample.net", "/en/", "net/"), "https://b.net": ("b.net", "", None),
    "https://b.net?x=/": ("b.net", "", None), "ftp://x.example.com/de/1": ("x.example.com", "/de/1", "example.com/de/"), "http://x.example.com/de": ("x.example.com", "/de", None),
    "http://org/fr/": ("org", "/fr/", "org/fr/"), "http://É.org/fr/é#x": ("É.org", "/fr/é", "org/fr/"), "http://x/a://b/c": ("x", "/a://b/c", None), "http://a#b/c": ("a", "", None), "http://a.org/fr/\nx": ("a.org", "/fr/\nx", "org/fr/"),
}


def test_hosts_paths_and_rules(spark):
    frame = pages(spark, [(i, u, "") for i, u in enumerate(URLS)])
    verdicts = {r.name: r.verdict for r in RULES}
    for r in url_filter.judge(frame, RULES).collect():
        host, path, rule = list(URLS.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule), list(URLS)[r.page_id]
        assert r.verdict == verdicts[rule] if rule else r.verdict in ("block", "allow")


def test_rules_against_sql(spark, tmp_path):
    import duckdb

    frame = pages(spark, [(i, u, "") for i, u in enumerate(URLS)] + [(3, "http://x.net/", ""), (3, "http://x.net/", "")])
    for d, rows in (("/root/testdata/sf0.01", None), (str(tmp_path), frame)):
        if rows is not None:
            rows.coalesce(1).write.parquet(f"{d}/pages.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet{'' if rows is None else '/*.parquet'}'")
        found = queries.url_rules(spark, d)
        assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(found.columns)} FROM ({queries.ORACLE_SQL['url_rules']})").fetchall()))


def test_judging_without_rules_or_rows(spark):
    assert url_filter.judge(pages(spark, []), RULES).count() == 0
    assert url_filter.judge(pages(spark, [(1, "http://a.b/", "")]), []).count() == 1


def labelled_urls(seed, n, hosts):
    """URLs that are blocked for three parameters or more, whatever their host."""
    rng = np.random.RandomState(seed)
    urls = [f"http://{rng.choice(['spam', 'site'])}{rng.choice(hosts)}.x{rng.randint(9)}.{rng.choice(['com', 'org'])}/{'1' * rng.randint(1, 20)}?{'a=1&' * rng.randint(0, 6)}" for _ in range(n)]
    return urls, np.array([int(u.count("=") >= 3) for u in urls])


def cells_of(spark, urls):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    return np.array([r[0] for r in frame.orderBy("i").select(url_filter.suffix_cells(url_filter.host_of(F.col("u")))).collect()])


def test_trees_learn_lexical_labels_and_know_them_on_unseen_hosts(spark):
    urls, label = labelled_urls(0, 900, range(50))
    model = url_filter.train(spark.createDataFrame(list(zip(urls, label.tolist())), "url string, blocked int"))
    for hosts in (range(50), range(100, 150)):
        others, wanted = labelled_urls(1, 400, hosts)
        found = model.block_probability(others, cells_of(spark, others)) >= 0.5
        assert (found == wanted).mean() > 0.97


def test_one_verdict_of_a_suffix_says_nothing(spark):
    """All labelled .com URLs are blocked and all .org ones allowed: their suffixes are no evidence, a mixed one is."""
    rows = [(f"http://h{i}.a.{t}/{'x' * (i % 7)}", b) for i in range(60) for t, b in (("com", 1), ("org", 0), ("net", i % 3 > 0))]
    rows = [(u, int(b)) for u, b in rows]
    model = url_filter.train(spark.createDataFrame(rows, "url string, blocked int"))
    names = list(url_filter.FEATURES)
    probe = ["http://new.a.com/", "http://new.a.org/", "http://new.a.net/", "http://h0.a.com/", "http://new.b.museum/"]
    x = model.matrix(probe, cells_of(spark, probe))
    share, count = x[:, names.index("share 1")], x[:, names.index("count 1")]
    assert share[[0, 1, 3, 4]].tolist() == [model.prior] * 4 and count[[0, 1, 3, 4]].tolist() == [0.0] * 4
    assert share[2] == pytest.approx((40 + 2 * model.prior) / 62) and count[2] == pytest.approx(np.log1p(60))
    found = model.block_probability(probe[:2], cells_of(spark, probe[:2]))
    assert abs(found[0] - found[1]) < 0.5


def plain_counts(rows):
    total = {}
    for url, blocked in rows:
        host = url.split("://", 1)[1].split("/")[0]
        for k in (0, 1, 2, 3):
            key = (k, ".".join(host.split(".")[-k:]) if k else host)
            old = total.get(key, (0, 0))
            total[key] = (old[0] + blocked, old[1] + 1)
    return total


def test_suffix_counts_cover_all_labelled_rows(spark):
    rng = np.random.RandomState(4)
    rows = [(f"http://{rng.choice(list('abc'))}.{rng.choice(list('de'))}.net/{i}", int(rng.rand() < 0.5)) for i in range(300)] + [("http://net/1", 1), ("http://d.net/1", 0)]
    model = url_filter.train(spark.createDataFrame(rows, "url string, blocked int"), most_rows=10)  # the sample bounds the trees only
    frame = spark.createDataFrame([(k, s) for k, s in plain_counts(rows)], "k int, s string")
    for r in frame.select("*", F.pmod(F.xxhash64("k", "s"), F.lit(url_filter.CELLS)).alias("cell")).collect():
        assert tuple(model.counts[:, r.cell]) == plain_counts(rows)[r.k, r.s]


def plain_lexical(url):
    import math
    import re
    from collections import Counter

    url = url or ""
    bits = lambda t: -sum(c / len(t) * math.log2(c / len(t)) for c in Counter(t).values()) if t else 0.0
    host, path, query, fragment = (x or "" for x in re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", url).groups()) if "://" in url else ("",) * 4
    n = max(1, len(url))
    return [
        len(url), len(host), len(path), len(query), path.count("/"), host.count(".") + 1, sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host),
        sum(c.isalpha() for c in url) / n, bits(url), bits(host), len([p for p in query.split("&") if p]), len(re.findall(r"[^\w./:]", url)),
        max(map(len, re.split(r"\W", url))), float(url[:8].lower() == "https://"), float(bool(fragment)),
    ]


def test_lexical_features_against_a_loop():
    urls = [*URLS, "HTTPS://a.b/c?d=1&&e=2#", "https://x/?&a#b?c#d", "x" * 50_000 + "://y.z/" + "1" * 50_000, "a://b?c=d", "://", "http://h/p#f", "?&?", "http://é9.org/٣_x-y"]
    assert np.allclose(url_filter.lexical(urls), [plain_lexical(u) for u in urls])
    assert url_filter.lexical([]).shape == (0, len(url_filter.LEXICAL))


def test_judging_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(None, "http://a.net/x"), (1, "http://a.net/x"), (1, "http://a.net/x"), (2, None), (2, "http://" + "a" * 100_000 + ".net/")]
    frame = spark.createDataFrame([(*r, "h", "p", "r", "v", "u", 5) for r in rows], "page_id bigint, url string, host string, path string, rule string, verdict string, ruled string, _id int")
    found = url_filter.judge(frame, RULES).collect()
    assert sorted((repr(r.page_id), r.rule, r.verdict) for r in found if r.rule) == sorted((repr(i), "net/", "block") for i in (None, 1, 1, 2)) and len(found) == 5


def test_boosting_lowers_the_loss():
    rng = np.random.RandomState(1)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    loss = lambda m: np.log1p(np.exp(-np.where(y == 1, 1, -1) * m.margin(x))).mean()
    few, many = (url_filter.boost(x, y, rounds=r, depth=3) for r in (2, 30))
    assert loss(many) < loss(few) < np.log(2) and loss(many) < 0.1


# -- classifiers ---------------------------------------------------------------------------------


def test_dual_coordinate_descent_reaches_the_optimum():
    """The primal and dual objectives meet."""
    rng = np.random.RandomState(2)
    n, d = 120, 30
    dense = (rng.rand(n, d) < 0.2) * rng.rand(n, d)
    y = np.where(dense @ rng.normal(size=d) > 0, 1, -1)
    rows = [np.flatnonzero(r) for r in dense]
    indptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    index, value = np.concatenate(rows), np.concatenate([dense[i, r] for i, r in enumerate(rows)])
    w = quality.dual_coordinate_descent(indptr, index, value, y, c=1.0, epochs=2000)
    cost = np.where(y == 1, n / (2 * (y == 1).sum()), n / (2 * (y == -1).sum()))
    primal = lambda v: (v @ v) / 2 + (cost * np.maximum(0, 1 - y * (dense @ v[:-1] + v[-1]))).sum()
    v = np.append(w[:d], w[-1])
    for _ in range(300):
        assert primal(v) <= primal(v + rng.normal(size=d + 1) * 10 ** rng.uniform(-4, 0)) + 1e-2


def test_shapes_and_indicators():
    assert [shape(w) for w in ("THE!!", "Oneaen", "be,&&&&&", "|", "x12")] == ["A!!", "Aa", "a,&&&", "|", "a0"]
    of = Indicators().of
    for text in (b"", b" ", b"a", b"a a a b", "é É".encode() * 500):
        ids = of(text)
        assert len(ids) == len(set(ids.tolist()))
        assert sorted(ids) == sorted(Indicators().of(text))
    assert len(Beginnings().of(b"")) == 0 and len(Beginnings().of(b"idiots idiots calm")) > 0


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    return read("documents"), read("labels")


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    found = quality.classify(docs, quality.train(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert len(found) > 80 and (found.predicted == found.quality).mean() > 0.95
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.5)).all()


def plain_ngrams(text):
    """Keys of one and two words, and of one to three shapes, as the classifier takes them; a word said again is marked."""
    import re

    raw = text.split()
    words = [re.sub(r"^\W+|\W+$", "", w).lower() for w in raw]
    shapes = [(shape(w), i > 0 and words[i] == words[i - 1]) for i, w in enumerate(raw)]
    out = {("w", w) for w in words} | {("ww", a, b) for a, b in zip(words, words[1:])}
    return out | {("s", *t) for n in (1, 2, 3) for t in zip(*(shapes[i:] for i in range(n)))}


def test_ratios_scaling_and_scores_against_a_loop():
    """Log-count ratios, rows brought to length one, and the logistic score, by dictionaries of the n-grams themselves."""
    rng = np.random.RandomState(5)
    words = [f"Word{i}," if i % 4 else f"{i}{i}!" for i in range(30)]
    texts = [" ".join(rng.choice(words[: 30 if k % 2 else 15], rng.randint(0, 12))) for k in range(120)]
    label = np.array([k % 2 for k in range(120)])
    of = Indicators().of
    found = [of(t.encode()) for t in texts]
    grams = [plain_ngrams(t) for t in texts]
    assert [len(f) for f in found] == [len(g) for g in grams]  # no two n-grams share a cell here
    indptr = np.concatenate([[0], np.cumsum([len(f) for f in found])])
    model = quality.fit(indptr, np.concatenate(found), label)

    seen = [{g: sum(g in x for x, y in zip(grams, label) if y == c) for g in set().union(*grams)} for c in (0, 1)]
    total = [sum(s.values()) + quality.SIZE for s in seen]
    ratio = {g: np.log((seen[1][g] + 1) / total[1]) - np.log((seen[0][g] + 1) / total[0]) if seen[0][g] + seen[1][g] >= 3 else 0.0 for g in seen[0]}
    weight = {}
    for text, ids in zip(texts, found):  # a cell for each n-gram, found by what only it can be
        for g in plain_ngrams(text):
            alone = [i for i in ids if all((i in f) == (g in x) for f, x in zip(found, grams))]
            if len(alone) == 1:
                weight[g] = alone[0]
                assert model.square[alone[0]] == pytest.approx(ratio[g] ** 2, abs=1e-9)
    assert len(weight) > 40
    for ids, g in zip(found, grams):
        length = np.sqrt(sum(ratio[x] ** 2 for x in g))
        margin = model.bias + (sum(model.weight[i] for i in ids) / length if length else 0.0)
        assert model.score(ids) == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.offset))), abs=1e-9)


def test_shapes_of_very_long_words():
    assert shape("aB1" * 1000) == "aA0" * 1000
    long = ("x" * 300 + "1" + "y").encode()
    assert set(Indicators().of(long)) != set(Indicators().of(("x" * 302).encode()))  # what is behind 200 characters counts


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    found = toxicity.grade_texts(docs, toxicity.train(docs, labels)).join(labels.withColumnRenamed("toxic", "label"), "doc_id").where(in_fold("doc_id", 1)).toPandas()
    assert (found.toxic[found.label == 0] == 0).mean() > 0.97
    assert (found.toxic[found.label == 1] == 1).mean() > 0.7  # learnt from some 270 rows
    assert found.severity[found.label == 1].mean() > 3 * found.severity[found.label == 0].mean()
    assert found.severity.between(0, 3).all() and ((found.grade > 0) == (found.toxic == 1)).all()


def test_severity_gradient_is_that_of_differences():
    rng = np.random.RandomState(6)
    n, features = 60, 7
    grade = rng.randint(0, 4, n)
    r = np.repeat(np.arange(n), 3)
    f = rng.randint(0, features, len(r))
    theta = np.concatenate([rng.normal(size=features) / 3, [0.2, -0.5, 0.3]])
    value, gradient = toxicity.loss_and_gradient(theta, r, f, grade, features, 0.7)
    for i in range(len(theta)):
        step = np.eye(len(theta))[i] * 1e-5
        up, down = (toxicity.loss_and_gradient(theta + d, r, f, grade, features, 0.7)[0] for d in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-4)
    # and the loss is that of the probabilities of the grades
    t = theta[features] + np.concatenate([[0], np.cumsum(np.exp(theta[features + 1 :]))])
    model = toxicity.SeverityModel(np.arange(features), theta[:features], t)
    each = []
    for i in range(n):
        u = sum(theta[k] for k in f[r == i])
        over = np.concatenate([[1], 1 / (1 + np.exp(-(u - t))), [0]])
        each.append(over[grade[i]] - over[grade[i] + 1])
    assert value == pytest.approx(-np.log(each).sum() + 0.35 * (theta[:features] ** 2).sum())
    assert model.probabilities(np.array([2, 5])) == pytest.approx(1 / (1 + np.exp(-(theta[2] + theta[5] - t))))


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_repeated_rows_and_ids_with_several_labels(spark, kind):
    """Repeated rows are scored alike; an id with several labels has its smallest, as if it were labelled once."""
    texts = [f"good plain words number {i} here" if i % 2 else f"bad!! bad!! idiots {i} BUY" for i in range(90)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1.0), (None, texts[4], "x", 1.0)], "doc_id bigint, text string, grade string, severity double")
    once = [(i, i % 2, 1 - i % 2) for i in range(90)]
    table = lambda rows: spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
    more = table(once + [(i, 1, 1) for i in range(90)] + once[:5] + [(None, 1, 1)])
    if kind == "quality":
        results = [quality.classify(docs, quality.train(docs, t)).collect() for t in (table(once), more)]
    else:
        results = [toxicity.grade_texts(docs, toxicity.train(docs, t)).collect() for t in (table(once), more)]
    a, b = (sorted(map(repr, r)) for r in results)
    assert a == b and len(a) == 92 and len([r for r in results[0] if r.doc_id == 3]) == 2
    assert len({repr(r) for r in results[0] if r.doc_id == 3}) == 1


def test_ordinal_gradient_and_order(spark):
    """Thresholds ascend, and more markers mean a higher expected severity."""
    rng = np.random.RandomState(3)
    rows, label = [], []
    for _ in range(800):
        k = rng.choice(4, p=[0.7, 0.1, 0.1, 0.1])
        rows.append(np.unique(np.concatenate([rng.choice(50, 6) + 1000, rng.choice(5, k, replace=False)])))
        label.append(int(k > 0))
    indptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    model = toxicity.fit(indptr, np.concatenate(rows), np.array(label))
    assert (np.diff(model.thresholds) > 0).all()
    means = [np.mean([model.probabilities(np.arange(k)).sum()]) for k in range(4)]
    assert means == sorted(means) and means[3] > 3 * means[0]


@pytest.mark.parametrize("case", ["no labels", "one class", "no documents"])
def test_classifiers_without_much_to_learn(spark, case):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(["a b c", None, "", "d " * 2000])] + [(None, "no id", "x", "y")], "doc_id bigint, text string, score string, toxic string")
    labels = spark.createDataFrame([] if case == "no labels" else [(i, 1, 0) for i in range(4)] + [(2, None, None)], "doc_id bigint, quality int, toxic int")
    docs = docs.where("doc_id < 0") if case == "no documents" else docs
    n = 0 if case == "no documents" else 5
    found = quality.classify(docs, quality.train(docs, labels)).collect()
    assert len(found) == n and all(0 <= r.score <= 1 for r in found) and not any(r.held_out is None for r in found)
    found = toxicity.grade_texts(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == n and all(0 <= r.severity <= 3 for r in found)


# -- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tables):
    import corpus_pipeline

    docs, labels = tables
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, SF).toArrow())
        assert after.columns == columns and after.count() < before.count(), name
        assert after.join(before, columns, "left_anti").count() == 0
        before = after
    packed = corpus_pipeline.pack(spark, before, SF)
    assert packed.count() == before.count()
    found = before.join(labels, "doc_id").agg(F.avg("quality"), F.avg("toxic")).first()
    assert found[0] > 0.97 and found[1] < 0.1


def shingle_set(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def least_padding(lengths, buckets):
    """The least padding of at most so many buckets, by trying every start of every last bucket."""
    from functools import cache

    values = sorted(set(lengths))
    count = {v: lengths.count(v) for v in values}

    @cache
    def best(j, k):
        if j == 0:
            return 0
        if k == 0:
            return float("inf")
        return min(best(i, k - 1) + sum(count[v] * (values[j - 1] - v) for v in values[i:j]) for i in range(j))

    return best(len(values), buckets)


def test_pipeline_against_a_plain_one(spark):
    """The rows of run() against loops over the documents: models score texts one by one, all pairs are compared, bounds are tried."""
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    model = quality.train(docs, labels)
    kept = {i: t for i, t in rows.items() if model.score(Indicators().of(t.encode())) >= 0.5}
    model = toxicity.train(docs.where(F.col("doc_id").isin(list(kept))), labels)
    kept = {i: t for i, t in kept.items() if model.probabilities(Beginnings().of(t.encode()))[0] < model.limit}
    sets, top = {i: shingle_set(t, 5) for i, t in kept.items()}, {i: i for i in kept}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in kept:
        for b in kept:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    kept = {i: t for i, t in kept.items() if find(i) == i}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in kept.items()}

    found = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert {i: r.length for i, r in found.items()} == lengths and 20 < len(found) < len(rows)
    assert sum(r.padded_length - r.length for r in found.values()) == least_padding(list(lengths.values()), 16)
    batches = {}
    for r in found.values():
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for batch in batches.values():
        assert sorted(r.slot for r in batch) == list(range(len(batch)))
        assert len({r.padded_length for r in batch}) == 1 and len(batch) * batch[0].padded_length <= 65_536


DIRTY = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, grade string, length string, batch string, _row string"


def test_stages_handle_dirty_rows(spark):
    """Null and empty texts, null and repeated ids and clashing columns pass through every stage with their columns."""
    import corpus_pipeline

    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).collect()
    rows = [(r.doc_id, r.text, r.lang, None, r.n_chars, *["clash"] * 5) for r in some]
    rows += [(None, None, *[None] * 8), (None, "", *[None] * 8), (1000, None, *[None] * 8), (1001, " \n", *[None] * 8), (1001, " \n", *[None] * 8), (1002, "x" * 200_000, *["c"] * 2, None, *["c"] * 5)]
    docs = spark.createDataFrame(rows, DIRTY)
    for name, stage in corpus_pipeline.STAGES:
        for frame, most in ((docs, len(rows)), (docs.where("n_chars < 0"), 0)):
            found = stage(spark, frame, "/root/testdata/sf0.001")
            got = found.collect()
            assert len(got) <= most and (name == "packing" or found.columns == docs.columns), name
            if name != "packing":
                assert {repr(tuple(r)) for r in got} <= {repr(r) for r in rows}
            elif most:
                assert len(got) == most


def test_run_on_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_keep_one_of_each_group(spark):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (3, text), (9, text + " more"), (3, text), (7, "else"), (8, None), (10, ""), (None, text), (7, "else")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "extra") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 7, 8, 10, None], key=repr)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where("doc_id < 0"), SF).count() == 0


def test_near_duplicates_judge_each_text_of_a_repeated_id(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (5, b + " more"), (5, ""), (5, None), (3, c), (6, c + " more"), (6, "own text"), (8, a + " more")]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), SF).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(5, a), (5, b), (5, ""), (3, c), (6, "own text")])


@pytest.mark.parametrize("module", [quality, toxicity])
def test_training_gives_the_drivers_memory_back_before_and_after_the_fit(spark, monkeypatch, module):
    from weft.llm import _features

    said, fit = [], module.fit
    for m in (_features, module):
        monkeypatch.setattr(m, "give_back", lambda session: said.append("back" if session is spark else "no session"))
    monkeypatch.setattr(module, "fit", lambda *sample: said.append("fit") or fit(*sample))
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad text there") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    module.train(docs, labels)
    assert said == ["back", "fit", "back"]
