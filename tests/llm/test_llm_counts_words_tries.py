"""Token counts, spelling variants and the conversation trie against brute force."""

import collections
import hashlib
import random
import re
import zlib

import pytest
import sentencepiece

from trolley.llm import prefix_trie, spelling, token_counts
from trolley.llm.queries import PIECES, tokenizer_path

DOCS = "doc_id bigint, text string, key string, n bigint, pieces string, `row` int, known int, word string"


def docs_of(spark, rows, parts=3):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(i, t, "k", 7, "p", 1, 2, "w") for i, t in rows]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


def prose(seed, n=200, letters="abcdeéñ"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


ODD = [
    " leading", "trailing ", "  two  spaces   three    ", "\n\n\nlines\n \n x\r\n\ty", "a▁b ▁▁c▁", "<s> x </s><unk>",
    "日本語のテキスト 😀😀 é é", "x y　z \x00 \x1c", " ", "   ", "\n", "1234567890 3.14", "ﬁ①Ⅷ", "=" * 300,
]


@pytest.fixture(scope="module")
def documents():
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(20, None), (21, ""), (None, "no id here"), (None, None), (22, prose(1)), (22, prose(1)), (23, prose(1))]
    rows += [(30 + i, prose(i, 40)) for i in range(20)]
    rows += [(60, prose(2, 500_000)), (61, "long" * 3000 + " end")]
    return rows


def brute_counts(rows):
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    out = []
    for i, text in rows:
        n = len(model.encode(text or ""))
        out.append((str(i), len((text or "").encode()), n, n > 4096))
    return sorted(out)


@pytest.mark.parametrize("sent", [500_000, 40, 0])
def test_token_counts(spark, documents, sent):
    got = token_counts.count_tokens(docs_of(spark, documents), tokenizer_path(PIECES), sent=sent).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == brute_counts(documents)


def test_each_pretoken_is_counted_once(spark, documents):
    counts = token_counts.piece_counts(docs_of(spark, documents), tokenizer_path(PIECES))
    want = collections.Counter(p for _, t in documents for p in token_counts.pretokens(t))
    assert counts.count() == counts.select("key").distinct().count() == len(want)
    assert counts.agg({"n": "sum"}).first()[0] == sum(want.values())


def test_token_counts_of_no_documents(spark):
    none = docs_of(spark, []).limit(0)
    assert token_counts.count_tokens(none, tokenizer_path(PIECES)).collect() == []


TURNS = "conv_id bigint, turn bigint, role string, text string, depth int, n int, x1 string, digest string, pos int, h int"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "d", 3, 4) for r in rows], TURNS).repartition(3)


def brute_trie(rows):
    convs = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, prefix_digest(role, text), (role or "", text or "")))
    turns = {c: [t[3] for t in sorted(ts)] for c, ts in convs.items()}
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        head = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        paths[c] = tuple(turns.get(head, [])[:h] + turns[c][h:])
    nodes = collections.defaultdict(list)
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(prefix_trie.WORD, q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in members if len(paths[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def prefix_digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def chats(seed, n, most=9, kinds=3):
    rng, rows = random.Random(seed), []
    for c in range(n):
        size = rng.randint(1, most)
        rows += [(c, t, "user" if t % 2 == 0 else "bot", "say " * rng.randrange(kinds) + "x") for t in range(size)]
    return rows


@pytest.mark.parametrize("block", [1, 2, 4])
def test_trie(spark, block):
    rows = chats(1, 90)
    rows += [(200 + i, t, "user", f"same {t} words here") for i in range(30) for t in range(6)]
    rows += [(300 + i, t, "user", f"same {t} words here") for i in range(10) for t in range(i)]
    rows += [(-7, 0, None, None), (-7, None, "user", None), (-7, None, "user", "a"), (-20, 1, "", ""), (None, 0, "user", "lost")]
    rows += [(400, 1, "user", "tie"), (400, 1, "user", "eit"), (400, 1, "user", "tie"), (401, 1, "user", ""), (419, 5, "x", "word " * 50_000)]
    got = prefix_trie.trie(turns_of(spark, rows), block)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got.columns == columns
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_long_and_equal_conversations(spark, monkeypatch):
    """Conversations over many stretches of blocks, and a node where many conversations end."""
    monkeypatch.setattr(prefix_trie, "STRETCH", 3)
    monkeypatch.setattr(prefix_trie, "LISTED", 4)
    rows = [(c, t, "user", f"turn {t % 5}") for c in (20, 40, 41) for t in range(50 + c)]
    rows += [(c, 0, "user", "hi") for c in range(100, 300, 1)]
    got = prefix_trie.trie(turns_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_trie_of_no_conversations(spark):
    assert prefix_trie.trie(turns_of(spark, []).limit(0)).collect() == []


def brute_words(rows):
    counts = collections.Counter()
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words):
    forms, near_of = {}, {}
    for w in words:
        near = [v for v in words if one_apart(w, v)]
        near_of[w] = len(near)
        best = min(near, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, near_of[w], words.get(forms[w])))
    return sorted(out)


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_spelling_of_texts(spark):
    rng = random.Random(3)
    rows = [(None, "Lettera LETTERA lettera"), (1, None), (2, ""), (3, "naïvetéÿ NaïVeTéÿ×÷ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ ΣΑΣΑΣΑΣΑ")]
    stems = ["remember", "remembers", "remembr", "aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "abababab"]
    for i in range(120):
        weights = [400, 30, 3, 200, 15, 2, 1]
        rows.append((i, " ".join(rng.choices(stems, weights, k=rng.randint(0, 400)))))
    rows += [(7, "x" * 3000 + " " + "x" * 3001)] * 2 + [(8, "word,rememberé\n" * 200_000)]
    got = spelling.variants(docs_of(spark, rows))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute_groups(brute_words(rows))


@pytest.mark.parametrize("letters", ["ab", "abcé😀"])
def test_spelling_groups(spark, letters):
    """Dense words over small alphabets: every kind of edit, runs of equal letters, long chains of forms."""
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(0, 7))): rng.choice([1, 2, 3, 20, 25, 300, 4000, 50_000]) for _ in range(250)}
    words = {w: n for w, n in words.items() if w}
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = spelling.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n bigint"))
            assert sorted(map(tuple, got.collect())) == brute_groups(words)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trie_nodes_are_numbered(spark):
    """Equal prefixes have equal numbers, different ones different numbers without gaps."""
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    rows = spelling.numbered_trie(df).orderBy("rank").collect()
    assert [r.word for r in rows] == words and [r["rank"] for r in rows] == list(range(len(words)))
    number = {}
    for r in rows:
        for i, node in enumerate(r.path, 1):
            assert number.setdefault(r.word[:i], node) == node
    assert sorted(number.values()) == list(range(1, len(number) + 1))


def test_spelling_of_no_words(spark):
    assert spelling.variants(docs_of(spark, [(1, "short words"), (2, None)])).collect() == []
    assert spelling.variants(docs_of(spark, []).limit(0)).collect() == []
