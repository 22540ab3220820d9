"""Each operator against a brute-force version, over awkward rows: nulls, blanks, ties, copies."""

import collections
import hashlib
import random
import re
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trolley.llm import labelled as labelling
from trolley.llm import (
    extraction,
    fingerprints,
    licenses,
    mixing,
    near_duplicates,
    packing,
    quality,
    suffix_dedup,
    topk,
    toxicity,
)
from trolley.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, content string, size int"


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(i, t, "en", s, len(t or ""), 7, "x", None) for i, t, s in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def prose(seed, n=200):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def awkward():
    base = prose(1)
    w = base.split()
    rows = [(1, base, "a"), (2, base, "a"), (3, base.upper(), "b"), (4, None, "b"), (5, "", None), (6, " \t\n", "c")]
    rows += [(7, "one two", "c"), (8, "One TWO", "c"), (9, prose(2, 6000), "a"), (9, prose(2, 6000), "a"), (None, base, None)]
    rows += [(10 + i, " ".join(w[:i * 3] + ["new"] + w[i * 3 + 1:]), "a") for i in range(12)]
    rows += [(40 + i, prose(50 + i, 120) + " " + " ".join(w[:60]) + " " + prose(90 + i, 50), "d") for i in range(4)]
    rows += [(60, "ab" * 400, "d"), (61, "Haedat " * 90, "d")]
    return rows


def brute_components(rows, k, num, den):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets.append(grams)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((str(rows[i][0]), len(sets[i]), str(least[find(i)])) for i in range(len(rows)))), len(groups)


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80), (2, 60)])
def test_components(spark, awkward, k, num):
    likeness = near_duplicates.Likeness(k, num)
    got = near_duplicates.classes(docs_of(spark, awkward), likeness).collect()
    want, _ = brute_components(awkward, k, num, 100)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_copies_around_a_hub(spark):
    """Copies that are near the original, near each other, or near neither."""
    rng = random.Random(5)
    base = prose(3, 150).split()
    rows = [(0, " ".join(base), "a")]
    for i in range(1, 120):
        w = list(base)
        for _ in range(rng.randint(1, 14)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(w), "a"))
        if i % 5 == 0:
            w[rng.randrange(len(w))] = "y"
            rows.append((1000 + i, " ".join(w), "a"))
    got = near_duplicates.classes(docs_of(spark, rows), near_duplicates.Likeness(4, 85)).collect()
    want, _ = brute_components(rows, 4, 85, 100)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_one_of_each(spark, awkward):
    likeness = near_duplicates.Likeness()
    docs = docs_of(spark, awkward)
    kept = near_duplicates.keep_one(docs, likeness)
    _, groups = brute_components(awkward, 5, 80, 100)
    assert kept.columns == docs.columns and kept.count() == groups


def brute_removal(texts, window):
    starts = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if starts[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        n = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [1 << 20, 3000])
def test_repeats(spark, awkward, shard):
    got = suffix_dedup.remove_repeats(docs_of(spark, awkward), shard_bytes=shard).collect()
    want = brute_removal([(t or "").encode() for _, t, _ in awkward], 200)
    have = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert have == sorted((str(d[0]), *w) for d, w in zip(awkward, want, strict=True))


def test_repeats_of_small_windows(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 40))), "a") for i in range(60)]
    got = suffix_dedup.remove_repeats(docs_of(spark, rows), window=12, grams=(4, 9), shard_bytes=200).collect()
    want = brute_removal([t.encode() for _, t, _ in rows], 12)
    have = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert have == sorted((d[0], *w) for d, w in zip(rows, want, strict=True))


def test_parts_of_repeated_rows(spark):
    texts = [prose(300 + i, 300) for i in range(24)]
    rows = [(i, t, "a") for i, t in enumerate(texts)] * 3
    rows += [(100 + i, prose(400 + i, 60) + t[200:700] + prose(500 + i, 60), "a") for i, t in enumerate(texts)]
    docs = docs_of(spark, rows).repartition(7)
    got = suffix_dedup.remove_repeats(docs, shard_bytes=3000).collect()
    want = brute_removal([t.encode() for _, t, _ in rows], 200)
    have = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert have == sorted((d[0], *w) for d, w in zip(rows, want, strict=True))


def test_texts_without_repeats(spark, awkward):
    docs = docs_of(spark, awkward)
    kept = suffix_dedup.without_repeats(docs)
    want = brute_removal([(t or "").encode() for _, t, _ in awkward], 200)
    assert kept.columns == docs.columns
    sizes = sorted(len((r.text or "").encode()) for r in kept.collect())
    # a character cut in two goes as a whole
    assert all(abs(a - b) < 12 for a, b in zip(sizes, sorted(w[0] - w[1] for w in want), strict=True))


def test_packing(spark, awkward):
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(tokenizer_path())
    reader.encode_special_tokens = True
    odd = [(70, "It's 12 o'clock — naïve İstanbul ΣΑΣ é x y\x1cz <|endoftext|> 日本 😀!!", "a")]
    rows = awkward + odd
    got = packing.pack(docs_of(spark, rows), tokenizer_path(), 256).toPandas()
    want = []
    for i, t, _ in rows:
        ids = [*reader.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[at : at + 256], "<u4")
            want.append((str(i), piece, at, len(part), zlib.crc32(part.tobytes())))
    name = lambda x: "None" if x != x or x is None else str(int(x))
    have = zip(map(name, got.doc_id), got.piece, got.start, got.length, got.ids_crc32, strict=True)
    assert sorted(tuple(map(str, h)) for h in have) == sorted(tuple(map(str, w)) for w in want)
    for _, parts in got.groupby("sequence_id"):
        parts = parts.sort_values("offset")
        assert parts.offset.tolist() == [0, *np.cumsum(parts.length)[:-1]] and parts.length.sum() <= 256
    # pieces of more than half a sequence need one each
    assert got.sequence_id.nunique() <= max(-(-got.length.sum() // 256), (got.length > 128).sum()) + 2


def test_packing_as_an_untouched_tokenizer(spark):
    from tokenizers import Tokenizer

    from trolley.llm.queries import op1

    reader = Tokenizer.from_file(tokenizer_path())
    texts = ["end of text <|endoftext|> next", "a<|endoftext|>b é<|startoftext|>", "<|ENDOFTEXT|> <|endoftext|><|endoftext|>!\n", "plain", None]
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)]).write.parquet(f"{folder}/documents.parquet")
    want = [np.array([*reader.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]
    got = {r.doc_id: (r.length, r.ids_crc32) for r in op1(spark, folder).collect()}
    assert got == {i: (len(ids), zlib.crc32(ids.tobytes())) for i, ids in enumerate(want)}


def test_mixing(spark, awkward):
    rows = awkward + [(200 + i, prose(i, 30), "e") for i in range(300)]
    got = mixing.mix_sources(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by, source = collections.defaultdict(list), {i: s for i, _, s in rows}
    for r in got:
        assert r.taken % r.size == 0 if r.size else r.taken == 0
        assert r.taken <= 3 * r.size
        by[source[r.doc_id], r.target].append(r)
    assert sum(t for _, t in by) == pytest.approx(sum(r.size for r in got))
    for (_, target), own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own) * 2
    again = mixing.mix_sources(docs_of(spark, rows)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    docs = docs_of(spark, rows)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_mixing_rows_that_share_an_id(spark, tmp_path):
    """A hot id, copies of one text and null ids are cut through like any other rows."""
    copy = prose(3, 25)
    rows = [(7, prose(i, 25), "abc"[i % 3]) for i in range(150)] + [(8, copy, "abc"[i % 3]) for i in range(150)]
    rows += [(None, prose(400 + i, 25), "abc"[i % 3]) for i in range(90)] + [(i, prose(i, 25), "c") for i in range(900, 960)]
    docs = docs_of(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.mix_sources(docs).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.source_size, r.target].append(r)
    assert len(by) == len({r.target for r in got}) > 1
    for (_, target), own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= 25
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(mixing.ORACLE).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    # copies that nothing tells apart, and nothing else
    only = mixing.mix_sources(docs_of(spark, [(1, copy, s) for s in "aab" * 40])).collect()
    assert {r.copies for r in only} <= {0, 1, 2, 3} and len(only) == 120
    for target in {r.target for r in only}:
        assert abs(sum(r.taken for r in only if r.target == target) - target) <= 25


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).astype("f")], "x") for i in range(400)]
    rows += [(401, None, "x"), (402, [1.0, None], "x"), (450, [float("nan")] * 8, "x"), (403, [float("inf")], "x")]
    rows += [(500, [1.0, 2.0], "x"), (550, [], "x"), (None, [1.0] * 8, "x")] + [(600 + i, rows[50][1], "x") for i in range(9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, row string").repartition(3)
    got = topk.top_k(table, table.where("vec_id % 50 = 0")).collect()
    usable = [
        (i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    want = []
    for q, v in usable:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)[:5]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_top_k_of_wide_numbers(spark):
    rows = [(i, [float(i) * 1e15, 3.0]) for i in range(6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(table, table.where("vec_id = 2"), k=2).collect()
    assert [(r.vec_id, r.score > 0) for r in got] == [(1, True), (3, True)]


def test_shards_agree_with_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(30):
        rows = rng.integers(-9, 9, (300, 24))
        ids = rng.permutation(300)
        q = rng.integers(-9, 9, 24)
        at, scores = topk.search_shard(ids, np.ascontiguousarray(rows.T), 5, q, 5)
        full = sorted((-int(s), int(i)) for s, i in zip(rows @ q, ids, strict=True) if i != 5)[:5]
        assert [(-int(s), int(i)) for s, i in zip(scores, ids[at], strict=True)] == full


def test_fingerprints(spark, awkward):
    got = {}
    frame = fingerprints.edited_fingerprints(docs_of(spark, awkward), rarest=0.05, commonest=0.9)
    for r in frame.collect():
        got.setdefault(str(r.doc_id), []).append(r)
    hashed = {str(i): None for i, _, _ in awkward}
    assert got.keys() == hashed.keys() and sum(map(len, got.values())) == len(awkward)
    order = sorted(((i, t or "") for i, t, _ in awkward if i is not None), key=lambda x: -x[0]) + [(None, awkward[10][1])]
    by_text = collections.defaultdict(set)
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        k = len(t) // 3
        edited = t[: len(t) - k] + following[:k]
        own = [r for r in got[str(i)] if r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()]
        assert own and own[0].n_chars == len(t)
        by_text[t].add(own[0].fingerprint)
        assert 0 <= own[0].near_edited <= 1 and 0 <= own[0].near_next <= 1
    assert all(len(f) == 1 for f in by_text.values())
    assert len({next(iter(f)) for t, f in by_text.items() if len(t) > 500}) > 5


def test_fingerprints_of_few_terms(spark):
    # white space alone, one word each, few words: none has a term in the band
    rows = [(i, " " * i, "a") for i in range(5)] + [(10 + i, "語" * (30 + i), "a") for i in range(40)]
    rows += [(100 + i, prose(600 + i, 1 + i % 6), "a") for i in range(60)]
    got = fingerprints.edited_fingerprints(docs_of(spark, rows), rarest=0.2, commonest=0.9).collect()
    assert len({r.fingerprint for r in got}) == len({t for _, t, _ in rows})
    assert all(r.near_next < 1 for r in got)


def test_licenses(spark):
    rows = [
        (1, "x Released UNDER the MIT-License. y Apache license, version 2.0 z", "a"),
        (2, "cc by nc " * 3, "a"), (3, None, "a"), (4, "", "a"), (5, "under the mit licenses", "a"),
        (6, "This work is licensed under GNU General Public License, version 3", "a"), (7, "ccby nc é", "a"), (2, "cc by nc " * 3, "a"),
    ]
    got = collections.defaultdict(list)
    for r in licenses.scan(docs_of(spark, rows)).collect():
        got[r.doc_id].append(r)
    for i, t, _ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        at = [(j, label) for p, label in licenses.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[i][0]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == (min((a for a, _ in at), default=None), max((a for a, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert got[6][0].labels == "gpl-3" and 0.8 <= got[6][0].score < 1 and len(got[2]) == 2
    assert got[3][0].score == 0.0 and got[3][0].labels == ""


PAGE = (
    "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href='x'>Menu{0}</a></nav>"
    "<div class='ad'>Buy {0}</div><{1}><h1>Title {0}</h1><p>A &amp; b<br>c{0}<p><b>Second</b>\n one.</p>"
    "<ul><li>x<li>y</ul></{2}><div id='comments'><p>Nice {0}</p></div><footer>&copy; host {0}</footer></body></html>"
)
BODY = "Title {0}\n\nA & b c{0}\n\nSecond one.\n\nx\n\ny"


def test_extraction(spark):
    rows = []
    for i in range(8):
        rows.append((i, f"https://a.example/{i}", PAGE.format(i, "article", "article")))
        rows.append((100 + i, f"https://B.example:80/{i}", PAGE.format(i, "div class='content'", "div")))
    rows += [(200, "https://c.example/", PAGE.format(1, "article", "article")), (201, None, None), (202, "odd", ""), (203, "http://d.example", "plain &lt; text")]
    rows += [(204, "http://e.example", "<p>open <b>tag <i"), (0, "https://a.example/0", PAGE.format(0, "article", "article"))]
    table = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, page int").repartition(3)
    got = {(r.page_id, r.url): r for r in extraction.extract(table).collect()}
    assert len(got) == len(rows) - 1
    for i in range(8):
        assert got[i, f"https://a.example/{i}"].text == BODY.format(i)
        assert got[100 + i, f"https://B.example:80/{i}"].text == BODY.format(i)
    assert got[200, "https://c.example/"].text == BODY.format(1)
    assert got[201, None].text == "" and got[202, "odd"].text == ""
    assert got[203, "http://d.example"].text == "plain < text" and got[204, "http://e.example"].text == "open tag"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_constant_text_inside_the_container(spark):
    legal = "Legal text of the host. " * 60
    news = "<html><head><title>T</title></head><body><div class='shell'><div class='box'>Call us</div><div class='text'><p>{1}</p></div><div class='low'>" + legal + "</div></div></body></html>"
    shop = "<html><head><title>T</title></head><body><div class='goods'><p>{1}</p><p>Sent within two days</p></div></body></html>"
    rows = [(i, f"https://n.example/{i}", (news if i % 3 else shop).format(i, prose(i, 40))) for i in range(60)]
    rows += [(100 + i, "https://copies.example/a", news.format(0, prose(7, 40))) for i in range(6)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in extraction.extract(table).collect()}
    assert {i: got[i] for i in range(60)} == {i: prose(i, 40) for i in range(60)}
    # copies of one page do not make its article constant
    assert all(prose(7, 40) in got[100 + i] for i in range(6))


@pytest.mark.parametrize(
    "opening",
    ["div class='content-sidebar-wrap'", "main class='with-sidebar'", "article class='post comments-open'", "div id='search-page'", "section class='social'"],
)
def test_articles_with_the_names_of_asides(spark, opening):
    tag = opening.split()[0]
    page = f"<html><head><title>T</title></head><body><div class='sidebar ad'>aside {{0}}</div><{opening}><p>{{1}}</p></{tag}></body></html>"
    rows = [(i, f"https://w.example/{i}", page.format(i, prose(i))) for i in range(6)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: prose(i) for i in range(6)}


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(300):
        bad, toxic = i % 4 == 0, i % 5 == 1
        w = prose(i, 60).split()
        if toxic:
            w[7] = w[30] = "blastard" + w[3]
        text = " ".join(x + "%%%" for x in w) if bad else " ".join(w) + "."
        rows.append((i, text, "a"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    rows += [(300, None, "a"), (301, "", "a"), (None, prose(1, 20), "a"), (5, rows[5][1], "a")]
    labels += [(5, None, None), (None, 1, 1), (999, 0, 0)]
    return docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("score", "column", "cut"), [(quality.score_quality, "quality", 0.3), (toxicity.score_toxicity, "toxic", 0.5)])
def test_classifiers(labelled, score, column, cut):
    docs, labels = labelled
    got = score(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r[column] for r in labels.where(F.col(column).isNotNull()).collect()}
    right = []
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id])
    assert len(right) > 40 and np.mean(right) >= 0.9


def test_classifiers_without_labels(spark, labelled):
    docs, labels = labelled
    for score in (quality.score_quality, toxicity.score_toxicity):
        assert len({r.score for r in score(docs, labels.limit(0)).collect()}) >= 1
        one = labels.selectExpr("doc_id", "1 AS quality", "1 AS toxic")
        assert {r.predicted for r in score(docs, one).collect()} == {1}


def test_held_out_labels_teach_nothing(labelled):
    docs, labels = labelled
    flipped = labels.withColumn(
        "toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    first, second = (
        sorted((str(r.doc_id), r.score) for r in toxicity.score_toxicity(docs, x).collect()) for x in (labels, flipped)
    )
    assert first == second


def test_a_sampled_id_is_one_row(spark):
    rows = [(i, prose(i, 10), "a") for i in range(40)] + [(i, prose(1000 * i + j, 10), "a") for i in range(3) for j in range(50)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    for n in (10, 1000):
        sample = labelling.training_texts(docs_of(spark, rows), labels, "toxic", n, "doc_id", "text", 1).collect()
        known = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
        assert len(sample) == min(n, len(known)) and {r.text for r in sample} <= {t for _, t, _ in rows}


def test_few_labels_of_equal_number_teach(spark):
    # 40 and 40 labels: no n-gram is five standard deviations from chance
    text = lambda i: prose(700 + i, 60) + (" blastardly " if i % 2 else " ") + prose(900 + i, 60)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    toxic, clean = ([i for i in ids if i % 2 == odd][:40] for odd in (1, 0))
    labels = spark.createDataFrame([(i, i % 2) for i in toxic + clean], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs_of(spark, [(i, text(i), "a") for i in range(200)]), labels).collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if r.doc_id not in {*toxic, *clean}]) >= 0.9


def test_kept_quality_rows(labelled):
    docs, labels = labelled
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 200 <= kept.count() <= 260


def test_empty_tables(spark):
    docs = docs_of(spark, [(1, "a", "a")]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        packing.pack(docs, tokenizer_path()), mixing.mix_sources(docs), suffix_dedup.remove_repeats(docs),
        near_duplicates.classes(docs), near_duplicates.keep_one(docs), quality.score_quality(docs, labels),
        toxicity.score_toxicity(docs, labels), licenses.scan(docs), fingerprints.edited_fingerprints(docs),
        topk.top_k(vectors, vectors), extraction.extract(pages), suffix_dedup.without_repeats(docs), mixing.mixed_rows(docs),
    ):
        assert df.count() == 0


def edited_copies(n, seed=4):
    """Copies of one text of 150 words with one to five words replaced."""
    rng = random.Random(seed)
    base, rows = prose(77, 150).split(), []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randint(1, 5)):
            w[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "a"))
    return rows


def test_pairs_grow_with_the_copies(spark, monkeypatch):
    """Comparisons inside a group of near copies grow with their number, not with its square."""
    compared = {}

    def counting(df, label):
        out = plain(df, label)
        if label in ("stars", "rest-pairs"):
            compared[n] = compared.get(n, 0) + out.count()
        return out

    plain = near_duplicates.written
    monkeypatch.setattr(near_duplicates, "written", counting)
    for n in (150, 600):
        rows = edited_copies(n)
        got = near_duplicates.classes(docs_of(spark, rows)).collect()
        want, _ = brute_components(rows, 5, 80, 100)
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert compared[600] < 6 * compared[150], compared


def test_near_copies_with_clashing_columns(spark):
    rows = [(1, prose(1), "a"), (2, prose(1) + " end", "a"), (2, prose(1) + " end", "a"), (3, prose(2), "b"), (3, prose(2), "b"), (4, None, None)]
    docs = docs_of(spark, rows).selectExpr("*", "1 AS _kept_id", "2 AS _kept", "3 AS own_id", "4 AS own", "5 AS keep", "6 AS repeated", "7 AS c0")
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and kept.where("c0 <> 7 OR own <> 4").isEmpty()


def test_rows_without_repeats_with_clashing_columns(spark):
    shared = prose(5, 80)
    rows = [(i, f"{prose(60 + i, 20)} {shared} {prose(90 + i, 20)}", "a") for i in range(3)] + [(None, None, "b"), (4, "", None)]
    docs = docs_of(spark, rows).selectExpr(
        "*", "1 AS _kept", "2 AS _own_id", "3 AS own_id", "4 AS own_content", "5 AS kept", "6 AS c0", "7 AS n_bytes", "8 AS sha"
    )
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns
    got = {r.doc_id: r for r in cut.collect()}
    assert len(got) == 5 and got[None].text is None and got[4].text == ""
    assert all(shared[5:-5] not in got[i].text and prose(60 + i, 20)[:-5] in got[i].text and got[i]._kept == 1 for i in range(3))
    mixed = mixing.mixed_rows(docs.selectExpr("*", "9 AS hash", "10 AS spare", "11 AS copies", "12 AS kept_0"))
    assert mixed.columns[-4:] == ["hash", "spare", "copies", "kept_0"] and {r.spare for r in mixed.collect()} == {10}


def test_extraction_of_asides_with_compound_names(spark):
    """Sidebars, comments and notices go by ordinary compound names; a post's own header stays."""
    asides = ["comment-list", "user-comments", "post-comments", "related-posts", "share-buttons", "sidebar-left",
              "newsletter-signup", "site-nav", "ad-container", "widget", "site-header"]
    def page(i):
        boxes = "".join(f"<div class='{name}'><p>Aside {name} {i} says {prose(i * 50 + j, 4)}</p></div>" for j, name in enumerate(asides))
        return (f"<html><body><main><div class='post-header'><h1>Title {i}</h1></div><div class='story-body'>"
                f"<p>{prose(7000 + i, 150)}</p></div>{boxes}</main></body></html>")
    rows = [(i, f"http://shop.example/{i}", page(i)) for i in range(40)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Title {i}\n\n{prose(7000 + i, 150)}" for i in range(40)}
    # a box that holds most of a page is its text, whatever its name
    rows = [(i, f"http://talk.example/{i}", f"<body><div class='comment-list'><p>{prose(i, 90)}</p></div><p>{prose(800 + i, 3)}</p></body>") for i in range(5)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(prose(r.page_id, 90) in r.text for r in got)


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """Rows beyond one group of training rows move the scale, the weights and the cut."""
    monkeypatch.setattr(quality, "GROUP_ROWS", 60)
    good, bad = "a calm sentence about the sea and the town", "$$$ BUY NOW !!! |||| %%% 999"
    rows = [(i, f"{good if i % 3 else bad} {i}", "s") for i in range(400)]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)], "doc_id bigint, quality int, toxic int")
    groups = quality.training_groups(docs, labels, "quality", "doc_id", "text")
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    assert groups.agg(F.sum("n")).first()[0] == len(free) and groups.count() > 3
    x = np.concatenate([np.frombuffer(r.x).reshape(r.n, -1) for r in groups.collect()])
    model = quality.fit(groups)
    assert np.allclose(model.centre, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-6)
    strength = np.clip((x - model.centre) / model.scale, -8, 8) @ model.weights
    n_good = sum(i % 3 > 0 for i in free)
    assert model.cut == pytest.approx(np.quantile(strength, 1 - n_good / len(free), method="midpoint"))
    got = {r.doc_id: r.predicted for r in quality.score_quality(docs, labels).collect()}
    assert all(got[i] == int(i % 3 > 0) for i in range(400))


def test_near_copies_leave_no_passing_tables(spark):
    from pathlib import Path

    from trolley.storage import shared_dir

    rows = [(i, " ".join(f"w{(i % 5) * 40 + k}" for k in range(30)) + f" tail{i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    place = Path(shared_dir(spark).removeprefix("file://"))
    before = set(place.iterdir()) if place.exists() else set()
    kept = near_duplicates.keep_one(docs)
    left = {p.name.rsplit("-", 1)[0] for p in set(place.iterdir()) - before if not p.name.startswith(".")}
    assert left == {"kept"}
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4]


def test_slots_are_joined_in_parts(spark, monkeypatch):
    """The keys of sketches meet part by part, and are deleted before whole sets are compared."""
    from pathlib import Path

    from trolley.storage import shared_dir

    place = Path(shared_dir(spark).removeprefix("file://"))
    before = set(place.iterdir()) if place.exists() else set()
    met, lying = [], []

    def looking(df, label, **options):
        out = plain(df, label, **options)
        if label == "met-members":
            met.append({r.key for r in out.collect()})
        if label == "compared":
            lying.append({p.name.rsplit("-", 1)[0] for p in set(place.iterdir()) - before})
        return out

    plain = near_duplicates.written
    monkeypatch.setattr(near_duplicates, "written", looking)
    rows = edited_copies(30)
    got = near_duplicates.classes(docs_of(spark, rows)).collect()
    want, _ = brute_components(rows, 5, 80, 100)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    every = set().union(*met)
    assert every and sum(map(len, met)) == len(every) and max(map(len, met)) < len(every) / 2
    assert lying and not any("sketches" in names for names in lying)


def test_shuffle_files_go_with_their_action(spark):
    """Inside ``passing`` the files of a shuffle do not wait for the driver to collect its garbage."""
    import time
    from pathlib import Path

    from trolley.storage import passing, written

    places = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for d in places for f in Path(d).glob("*/shuffle_*.data")}

    before = files()
    with passing(spark):
        counted = written(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counted")
        until = time.time() + 10
        while files() - before and time.time() < until:
            time.sleep(0.2)
        assert not files() - before
        assert counted.count() == 7
