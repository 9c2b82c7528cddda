"""Each training-data operator against a plain version that looks at everything, and on awkward tables."""

import hashlib
import itertools
import random
import re
import time
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import decontaminate, fingerprints, html_text, near_dedup, packing, quality, secrets, suffix_dedup, url_filter, warc
from lodestone.llm.graph import components
from lodestone.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def make(spark, rows):
    """documents with the given (doc_id, text) and an extra column named like an inner one."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1) for i, t in rows], DOCS + ", cluster int")


AWKWARD = [(3, None), (1, ""), (2, " \t\n"), (4, "one two"), (5, "One  TWO"), (6, "x" * 30_000), (6, "x" * 30_000), (None, "no id here"), (7, "a b c d e f " * 3000)]


# --- 10


def plain_sets(t):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(items, percent=85):
    sets = {i: plain_sets(t) for i, t in items}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_components(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_components(docs).collect()}
    want = plain_components(texts.items())
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


@pytest.mark.parametrize("limit", [1000, 3])
def test_near_components_of_copies(spark, limit):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(900)}" for _ in range(140)]
    rows = []
    for i in range(40):  # copies with up to 6 changed words: some linked with each other only through others
        w = list(base)
        for _ in range(i % 7):
            w[rnd.randrange(len(w))] = f"z{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"u{i}-{j}" for j in range(60))) for i in range(5)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_components(make(spark, rows), group_limit=limit, block=4).collect()}
    assert got == plain_components(rows)


def test_near_components_awkward(spark):
    got = near_dedup.near_components(make(spark, AWKWARD)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in AWKWARD)
    by = {r.doc_id: r for r in got}
    assert by[3].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[5].component_id == 4
    assert by[None].component_id is None and not by[None].kept
    assert near_dedup.near_components(make(spark, [])).count() == 0


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_texts_that_polynomials_confuse(spark):
    a, b = thue_morse(11)
    rows = [(1, a), (2, b), (3, f"{a} x y z w"), (4, f"{b} x y z w"), (5, a.upper())]
    assert {r.doc_id: r.component_id for r in near_dedup.near_components(make(spark, rows)).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    got = {r.doc_id: r for r in fingerprints.fingerprint(make(spark, rows[:2])).collect()}
    assert got[1].fingerprint != got[2].fingerprint and got[1].near_next == 0.0
    assert repeats(make(spark, rows[:2])) == plain_repeats(rows[:2])


def test_near_components_of_long_texts_in_blocks(spark):
    rnd = random.Random(6)
    base = [f"w{rnd.randrange(5000)}" for _ in range(900)]
    rows = []
    for i in range(12):
        w = list(base)
        for _ in range(i * 4):
            w[rnd.randrange(len(w))] = f"z{i}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_components(make(spark, rows), shingles=2000).collect()}
    assert got == plain_components(rows)


def test_components_against_plain(spark):
    rnd = random.Random(13)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (None, 3), (4, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


# --- 2


def plain_spans(t):
    out = []
    for k, p, g, least in (("assign", secrets.KINDS[0][1], 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)):
        out += [(k, m.start(), m.end()) for m in re.finditer(p, t) if len(m[g]) >= least]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def plain_all_spans(t, scope=200):
    base = plain_spans(t)
    weak = [(k, m.start(), m.end()) for k, p, g, least in secrets.KINDS[3:] for m in re.finditer(p, t) if len(m[g]) >= least]
    has_id = [a for k, a, _ in base + weak if k in ("access", "user")]
    strong = lambda a: any(k == "assign" and abs(a - x) <= scope for k, x, _ in base)
    keys = [a for k, a, _ in weak if k == "key"]
    near = lambda a, others: any(abs(a - x) <= scope for x in others)
    out = list(base)
    for k, a, b in weak:
        if any(a < y and b > x for _, x, y in base):
            continue
        ident, secret = near(a, has_id), strong(a) or near(a, keys)
        if (k == "key" and ident) or (k == "user" and secret) or (k == "endpoint" and ident and secret):
            out.append((k, a, b))
    order = [k[0] for k in secrets.KINDS]
    return sorted(out, key=lambda s: (s[1], order.index(s[0])))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_secrets(spark, docs, texts):
    got = secrets.scan(docs).collect()
    for r in got:
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in want) for k in ("assign", "access", "hex"))


def test_linking_against_all_pairs(spark):
    rnd = random.Random(11)
    parts = ["AKIA" + "Q7" * 8, "AKIAB12", "user=bob_1", "login : x9", "password=hunter22", "token = ab", "Zx9" * 12, "aB3-_/" * 8, "https://h.example/p", "host: db.example.com:5432", "0123456789abcdef" * 2, "secret=token:abcdef"]
    rows = [(i, "".join(rnd.choice(parts) + " é" * rnd.randrange(60) + rnd.choice([" ", "\n", ", "]) for _ in range(rnd.randrange(1, 14)))) for i in range(150)]
    got = {r.doc_id: r.spans for r in secrets.scan(make(spark, rows)).collect()}
    assert got == {i: joined(plain_all_spans(t)) for i, t in rows} and sum("key:" in x or "endpoint:" in x for x in got.values()) > 40


def test_secret_linking(spark):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
    linked = f"é AKIA{'A1' * 8} then {key} at https://db.example.com/x"
    rows = [(1, linked), (2, f"only {key} and https://db.example.com/x"), (3, f"AKIA{'B2' * 8}" + " filler" * 60 + f" {key}"), (4, None), (5, "user: bob9 password = hunter22"), (5, "user: bob9 password = hunter22"), (None, "token=abcdef"), (6, "TOKEN : 'abc' secret=token:abcdef"), (7, "AKIAX" + "AKIA" * 5 + " AKIAB 0123456789abcdef01234567g" + "f" * 23)]
    got = defaultdict(list)
    for r in secrets.scan(make(spark, rows)).collect():
        got[r.doc_id].append(r)
    kinds = lambda i: [x.split(":")[0] for x in got[i][0].spans.split(",") if x]
    assert kinds(1) == ["access", "key", "endpoint"] and kinds(2) == [] and kinds(3) == ["access"] and kinds(4) == []
    assert kinds(5) == ["user", "assign"] and len(got[5]) == 2 and kinds(None) == ["assign"] and kinds(6) == []
    assert got[7][0].base_sha256 == hashlib.sha256(joined(plain_spans(rows[-1][1])).encode()).hexdigest() and kinds(7) == ["access", "hex"]
    spans = [x.split(":") for x in got[1][0].spans.split(",")]
    assert [linked[int(a) : int(b)] for _, a, b in spans] == [f"AKIA{'A1' * 8}", key, "https://db.example.com/x"]
    red = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(make(spark, rows)).collect()}
    assert red[1][0] == "é [REDACTED] then [REDACTED] at [REDACTED]" and red[1][1] == len(red[1][0]) and red[4] == (None, None) and red[2][0] == rows[1][1]
    assert secrets.scan(make(spark, [])).count() == 0


# --- 3


def plain_repeats(items, length=100):
    seen, out = set(), {}
    for i, t in items:
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        gone = gone[:-1]
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(gone) else 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone]) if len(raw) else b""
        out.setdefault(i, []).append((len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeats(df, **k):
    out = defaultdict(list)
    for r in suffix_dedup.remove_repeats(df, **k).collect():
        out[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    return {i: sorted(x) for i, x in out.items()}


def test_suffix_array():
    rnd = random.Random(1)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 50, 200]:
        for alphabet in (1, 2, 4):
            s = np.array([rnd.randrange(1, alphabet + 1) for _ in range(n)], np.int64)
            assert suffix_dedup.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_repeats(docs, texts):
    assert repeats(docs) == plain_repeats(sorted(texts.items()))


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_at_edges(spark, hot):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 7)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(30):
        cut = rnd.randrange(len(passage) - 110)
        rows.append((i, " ".join(word() for _ in range(20)) + passage[cut : cut + rnd.randrange(90, 140)] + " ".join(word() for _ in range(20))))
    rows += [(50, "ab" * 300), (51, "a" * 99), (52, "a" * 350), (53, None), (54, "")]
    assert repeats(make(spark, rows), hot=hot) == plain_repeats([(i, t or "") for i, t in rows])


def test_repeats_awkward(spark):
    order = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert repeats(make(spark, AWKWARD)) == {i: sorted(x) for i, x in plain_repeats([(i, t or "") for i, t in order]).items()}
    assert suffix_dedup.remove_repeats(make(spark, [])).count() == 0


def test_repeats_of_many_rows_without_id(spark):
    rnd = random.Random(8)
    texts_ = [" ".join(f"{rnd.randrange(10**6)}" for _ in range(30)) for _ in range(12)]
    rows = [(None, texts_[k % 12]) for k in range(60)] + [(7, texts_[3] + texts_[4]), (7, texts_[4])]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert repeats(make(spark, rows)) == {i: sorted(x) for i, x in plain_repeats(order).items()}


@pytest.mark.parametrize("most", [200_000, 3])
def test_only_runs_that_may_share_a_window_are_gathered(most):
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    line, passage = noise(40), noise(130)

    def sifted(texts_, most):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts_)), pa.int64()), pa.array([0] * len(texts_), pa.int32()), pa.array(texts_)], names=["ord", "dup", "text"])
        rows = pa.Table.from_batches(suffix_dedup._run_batches(100, 16)([batch])).sort_by([(c, "ascending") for c in ("anchor", "content", "ord", "dup", "start")])
        return [r for b in suffix_dedup._sift(most)(iter(rows.to_batches(max_chunksize=2))) for r in b.to_pylist()]

    if most > 30:
        assert sifted([noise(150) + line + noise(150) for _ in range(30)], most) == []
    texts_ = [noise(150) + passage[k:] + noise(150) for k in range(20)]
    seen, later = set(), set()
    for i, t in enumerate(texts_):
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                later.add((i, k))
            seen.add(t[k : k + 100])
    assert later and later <= {(r["ord"], r["start"] + k) for r in sifted(texts_, most) for k in range(r["windows"])}


# --- 4


def plain_alignment(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[-1] - 1))
        best, above = max(best, *row), row
    return best


def test_smith_waterman():
    rnd = random.Random(2)
    for _ in range(40):
        a, b = ([rnd.randrange(5, 9) for _ in range(rnd.randrange(1, 20))] for _ in range(2))
        got = decontaminate.smith_waterman(np.array([a], np.uint64), np.array([b], np.uint64))
        assert got[0] == plain_alignment(a, b)


def test_contamination(spark, docs, texts, sf):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    low = lambda t: t.lower().split()
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if " ".join(low(x)) in " ".join(low(t))}
    assert whole <= got
    for d, i in got:
        assert plain_alignment(low(items[i]), low(texts[d])) >= 0.5 * 2 * len(low(items[i]))


def test_contamination_of_edits(spark):
    rnd = random.Random(5)
    words = [f"w{rnd.randrange(300)}" for _ in range(40)]
    edited = [w if k % 5 else "new" for k, w in enumerate(words)]
    other = [f"v{rnd.randrange(300)}" for _ in range(200)]
    rows = [(1, " ".join(other[:90] + edited + other[90:])), (2, " ".join(other)), (3, " ".join(words).upper()), (4, None), (5, ""), (3, " ".join(words)), (None, " ".join(words))]
    bench = spark.createDataFrame([(7, " ".join(words), 0), (8, None, 0), (9, "only three words", 0), (10, "", 0)], "item_id long, text string, doc_id int")
    for size in (8_000_000, 60):
        got = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(make(spark, rows), bench, block_bytes=size).collect())
        assert got == {(1, 7): 1, (3, 7): 2, (None, 7): 1}
    assert decontaminate.contaminated_pairs(make(spark, []), bench).count() == 0
    assert decontaminate.contaminated_pairs(make(spark, rows), bench.limit(0)).count() == 0


def test_contamination_of_lone_edited_copies(spark):
    rnd = random.Random(7)
    items = {i: [f"w{i}-{j}" for j in range(n)] for i, n in enumerate([40] * 6 + [15] * 30)}
    other = lambda i, n: [f"v{i}-{j}" for j in range(n)]
    rows = {}
    for i, w in items.items():  # each copy is its item's only one: every fourth word new, a long gap, or random words new
        copy = [x if (k + i) % 4 else f"new{i}-{k}" for k, x in enumerate(w)] if i < 4 else list(w)
        if i in (4, 5):
            copy[20:20] = other(f"gap{i}", 34 + i)
        for k in rnd.sample(range(len(w)), 4) if i > 5 else ():
            copy[k] = f"new{i}-{k}"
        rows[i] = other(i, 50) + copy + other(f"end{i}", 50)
    rows[100] = other(100, 50) + items[6][:3] + other("end100", 50)  # one run of an item makes no copy
    runs = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    want = {(d, i) for d, t in rows.items() for i, w in items.items() if runs(w) & runs(t) and plain_alignment(w, t) >= len(w)}
    assert {(i, i) for i in range(6)} <= want and len(want) > 30
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(make(spark, [(d, " ".join(t)) for d, t in rows.items()]), bench).collect()]
    assert sorted(got) == sorted(want)


def test_contamination_by_passages_of_long_items(spark):
    item = [f"w{j}" for j in range(300)]
    pad = [f"v{j}" for j in range(40)]
    split = item[100:140] + pad[:30] + item[140:175]  # 75 words with a gap, worth 60
    rows = [(1, item[20:160]), (2, item[100:150]), (3, item[100:149]), (4, split), (5, item[100:140] + pad + item[140:145]), (6, item[:20] + pad + item[250:])]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(f"u{j}" for j in range(59)))], "item_id long, text string")
    docs = make(spark, [(d, " ".join(pad + t + pad)) for d, t in rows] + [(9, " ".join(f"u{j}" for j in range(29)))])
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated_pairs(docs, bench).collect()}
    assert got == {(d, 7): plain_alignment(item, pad + t + pad) / 600 for d, t in rows if plain_alignment(item, pad + t + pad) >= 100}
    assert {d for d, _ in got} == {1, 2, 4, 6}


def test_contamination_against_all_pairs(docs, texts, spark, sf):
    """Every pair of document and item is aligned, with no seeds at all."""
    items = {r.item_id: r.text.lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    number = defaultdict(lambda: len(number) + 10)
    coded = lambda ws: np.array([number[w] for w in ws], np.uint64)
    items = {i: coded(w) for i, w in items.items()}
    want = set()
    for d, t in texts.items():
        h = coded(re.sub("[A-Z]", lambda m: m[0].lower(), t).split())
        for s, (i, w) in zip(decontaminate._aligned(list(items.values()), [h] * len(items)), items.items(), strict=True):
            if len(w) and s >= min(len(w), 100):
                want.add((d, i))
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()]
    assert sorted(got) == sorted(want) and want


@pytest.mark.parametrize("every", [3, 4, 5, 6])
def test_contamination_of_regular_edits(spark, sf, every):
    """Each item once, every n-th word replaced, or a word put in after every second one: no seed needs three words in a row."""
    items = {r.item_id: r.text.split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows, want = [], set()
    for i, w in items.items():
        changed = [x if (k + 1) % every else f"new{i}-{k}" for k, x in enumerate(w)]
        longer = [y for k, x in enumerate(w) for y in ([x, f"put{i}-{k}"] if k % 2 else [x])]
        for k, copy in enumerate((changed, longer)):
            rows.append((2 * i + k, " ".join([f"a{i}", *copy, f"z{i}"])))
            if plain_alignment([x.lower() for x in w], [x.lower() for x in copy]) >= min(len(w), 100):
                want.add((2 * i + k, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(make(spark, rows), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert want <= got and len(want) >= len(items)


def test_contamination_by_random_edits_of_few_words(spark):
    """Few different words, short items, one and two words: the pairs are those of the plain alignment."""
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randrange(40)}"
    items = {i: [word() for _ in range(rnd.choice([1, 2, 3, 4, 6, 9, 14, 30]))] for i in range(40)}
    rows = {}
    for d in range(120):
        base = list(rnd.choice(list(items.values())))
        for _ in range(rnd.randrange(len(base) + 1)):
            k = rnd.randrange(len(base) + 1)
            base[k : k + rnd.randrange(2)] = [word()] * rnd.randrange(2)
        rows[d] = [word() for _ in range(rnd.randrange(30))] + base + [word() for _ in range(rnd.randrange(30))]
    want = {(d, i) for d, t in rows.items() for i, w in items.items() if plain_alignment(w, t) >= len(w)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(make(spark, [(d, " ".join(t)) for d, t in rows.items()]), bench.union(bench.limit(1))).collect()]
    extra = [p for p in got if p[1] == min(i for i in items)]
    assert set(got) == want and len(got) == len(want) + len(set(extra))


# --- 5

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and more, and more, and more of them, all the time.</p></div>
<article><h1>A  &amp; B</h1><p>First, paragraph with <b>bold</b> words, of some length, to score.<br><p>Second one &eacute;&#233; is here, with
 a line feed, <a href=y>a link</a>.<script>var x = "</p>";</script><ul><li>item one<li>item two</ul><form><p>Name, mail</p></form>
<div class="comments"><p>I liked it, really, a lot, more than anything, and so on.</p></div></article>
<aside><p>Other, stories, of, interest, to, you, and, many, commas, here.</p></aside><footer>&copy; 2020</footer></body></html>"""


def test_main_text(spark, sf):
    want = "A & B\nFirst, paragraph with bold words, of some length, to score.\nSecond one éé is here, with a line feed, a link.\nitem one\nitem two"
    assert html_text.main_text(PAGE) == want
    divs = PAGE.replace("<article>", '<div id="content">').replace("</article>", "</div>")
    assert html_text.main_text(divs) == want
    for page in (None, "", "<", "<p", "<!--", "<script>", "</p></div>", "plain text of a page", "<div " * 50, "<b>" * 3000):
        assert isinstance(html_text.main_text(page), str)
    for r in html_text.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        import html

        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in inner)
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    rows = spark.createDataFrame([(1, None, None, 5), (None, "u", "", 5), (2, "u", PAGE, 5), (2, "u", PAGE, 5)], "page_id long, url string, html string, text int")
    assert Counter((r.page_id, r.n_chars) for r in html_text.extract(rows).collect()) == {(1, 0): 1, (None, 0): 1, (2, len(want)): 2}
    assert html_text.extract(rows.limit(0)).count() == 0


@pytest.mark.parametrize("tag", ["svg", "math", "video", "audio", "canvas", "template", "noscript"])
def test_main_text_after_unclosed_elements(tag):
    first, second = (f"{x}, with words, and commas, of a good length to score." for x in ("First", "Second"))
    page = "<body><article><p>{}</p>{}<p>{}</p>{}</article></body>"
    text = lambda a, b="": html_text.main_text(page.format(first, a, second, b))
    own = [f'<{tag} class="a"/>', f"<{tag} />"] if tag in ("svg", "math") else []
    for start in [f"<{tag}>", f'<{tag} class="a">', f"<{tag} src=a/>", *own]:
        for later in ("", f"<{tag}>gone</{tag}>", f"<{tag}>gone<{tag}>gone</{tag}></{tag}>"):
            assert text(start, later) == f"{first}\n{second}"
    for closed in (f"<{tag}>gone</{tag}>", f"<{tag}>gone<{tag}>gone</{tag}>gone</{tag}>", f"<{tag}>gone<!-- <{tag}> --><script>'<{tag}>'</script></{tag.upper()} >"):
        assert text(closed) == f"{first}\n{second}"
    assert html_text.main_text(f"<p>{first}</p>" + f"<{tag}>" * 20_000 + f"<p>{second}</p>") == f"{first}\n{second}"


@pytest.mark.parametrize("wrap", ['<div class="content has-sidebar">{}</div>', '<div class="no-header">{}</div>', "<form action=x>{}</form>", '<form><div id="widget">{}</div></form>', '<div class="content-with-sidebar">{}', '<div class="page hidden-menu">{}</div>'])
def test_main_text_in_wrappers(wrap):
    first, second = (f"{x}, with words, and commas, of a good length to score." for x in ("First", "Second"))
    inner = f'<nav><p>Home, and, away</p></nav><article><p>{first}</p><p>{second}</p></article><div class="sidebar-left"><p>Other things</p></div>'
    assert html_text.main_text(f"<body>{wrap.format(inner)}<footer><p>end</p></footer></body>") == f"{first}\n{second}"


def test_readers_comments_go_even_if_they_are_most(spark):
    article = "A short article, of one paragraph, that many readers comment on."
    page = f'<body><div><article><p>{article}</p></article><div class="post-comments">' + "<p>I think so too, really, and more, of that, please.</p>" * 30 + "</div></div></body>"
    assert html_text.main_text(page) == article


def test_articles_in_unwanted_elements_go_with_them():
    article = "The article, of one paragraph, that is the text of the page, and of a good length."
    for box in ("<div class=related-stories><article><p>{0}</p></article><article><p>{0}</p></article></div>", "<aside><article><p>{0}</p></aside>"):
        assert html_text.main_text(f"<body><article><p>{article}</p><p>{article}</p></article>{box.format('Other story, and more, of this.')}<p>x</p></body>") == f"{article}\n{article}"


@pytest.mark.parametrize("page", ["<object>" * 40_000, "<select>" * 40_000, "<p>a" + "<b>x</i>" * 40_000, "<i><table>" + "<b>" * 20_000 + "</i>" * 20_000, '<div class="ad">' * 20_000, "<form>" * 20_000 + "<p>a</p>" * 200 + "</form>" * 20_000, "<li>" * 30_000])
def test_main_text_takes_no_square_time(page):
    began = time.time()
    html_text.main_text("<body>" + page)
    assert time.time() - began < 4


# --- 6


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("pmod(xxhash64(doc_id), 2) = 0")
    got = {r.doc_id: r for r in quality.score(docs, train).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id].keep, r.quality) for r in labels.where("pmod(xxhash64(doc_id), 2) = 1").collect()]
    assert sum(k == bool(q) for k, q in held) >= 0.97 * len(held)
    assert sum(q and not k for k, q in held) <= 0.01 * len(held)


def test_quality_shrinks_sparse_sites(spark):
    good, bad = "Plain words of a calm text that goes on for a while here", "BUY!! BUY!! NOW!! NOW!! | | $$$ $$$ ### $$$"
    rows = [(i, good if i % 2 else bad, "en", "mixed", 0) for i in range(200)] + [(1000 + i, bad, "en", "poor", 0) for i in range(60)] + [(2000, bad, "de", "tiny", 0), (2001, None, None, None, None), (None, "", "en", "mixed", 0), (1, good, "en", "mixed", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("host", F.lit(1)).withColumn("n", F.lit(2))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)] + [(None, 1, 0), (5000, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[101].keep and not by[100].keep and by[1000].host_mean < by[2000].host_mean < 0.6
    assert quality.score(docs, labels.limit(0)).where("keep").count() == len(rows)
    assert quality.score(docs.limit(0), labels).count() == 0


def plain_quality(rows, share):
    """p_quality of rows (host, path, p) by the formulas, each document left out at every level."""
    sites, hosts = defaultdict(list), defaultdict(list)
    for h, q, p in rows:
        sites[h, q].append(p)
        hosts[h].append(p)
    n, total = len(rows), sum(p for *_, p in rows)
    mean = min(max(total / n, 1e-4), 1 - 1e-4)

    def weight(groups):  # [(sum, size, prior)]
        g = [(t, k, m) for t, k, m in groups if k > 1]
        inner = sum(k * m * (1 - m) for _, k, m in g)
        if len(g) < 2 or not inner:
            return 100.0
        size = sum(k for _, k, _ in g)
        inner /= size
        between = (sum(k * (t / k - m) ** 2 for t, k, m in g) / size - inner * len(g) / size) / max(1 - len(g) / size, 1e-9)
        return min(max(inner / max(between, 1e-9) - 1, 1.0), 1e5)

    w_host = weight([(sum(x), len(x), mean) for x in hosts.values()])
    of_host = {h: (sum(x) + w_host * mean) / (len(x) + w_host) for h, x in hosts.items()}
    w_path = weight([(sum(x), len(x), of_host[h]) for (h, _), x in sites.items()])
    clip = lambda p: min(max(p, 1e-6), 1 - 1e-6)
    logit = lambda p: np.log(p / (1 - p))
    out = []
    for h, q, p in rows:
        rest = (total - p) / (n - 1) if n > 1 else share
        on_host = (sum(hosts[h]) - p + w_host * rest) / (len(hosts[h]) - 1 + w_host)
        others = (sum(sites[h, q]) - p + w_path * on_host) / (len(sites[h, q]) - 1 + w_path)
        out.append(1 / (1 + np.exp(-(logit(clip(p)) + logit(clip(others)) - np.log(mean / (1 - mean))))))
    return out


def test_quality_against_formulas(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for table in (docs, docs.limit(1)):
        got = table.select("doc_id", "source", "lang").join(quality.score(table, labels), "doc_id").collect()
        want = plain_quality([(r.source or "", r.lang or "", r.p_document) for r in got], 1.0)
        if len(got) > 1:
            assert np.allclose([r.p_quality for r in got], want, atol=1e-9)
    assert len(got) == 1


def test_fit_holds_one_text_of_each_id(spark):
    rows = [(1, f"calm words of text {i}") for i in range(300)] + [(2, "BUY!! NOW!! $$$")]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    model, share = quality.fit(make(spark, rows), labels)
    assert share == 0.5 and model is not None


# --- 7


def plain_pieces(texts, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    out = {}
    for i, t in texts.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), capacity)):
            p = ids[s : s + capacity]
            out[i, k] = (s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()))
    return out


def check_places(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing(docs, texts):
    rows = packing.pack(docs, tokenizer_path()).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == plain_pieces(texts, 4096)
    assert check_places(rows, 4096) == -(-sum(r.length for r in rows) // 4096)


def test_packing_awkward(spark):
    odd = [*AWKWARD, (8, "İstanbul ΣΑΣ e\u0301 don't <|endoftext|>x\u00a0y\u2003z \x1c q"), (9, "'s 'S 123 ½ 漢字かな !!!")]
    rows = packing.pack(make(spark, odd), tokenizer_path(), capacity=512).collect()
    check_places(rows, 512)
    want = plain_pieces(dict(enumerate(t or "" for _, t in odd)), 512)
    assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter((k, *v) for (_, k), v in want.items())
    assert packing.pack(make(spark, []), tokenizer_path()).count() == 0


def test_bin_completion_reaches_optimum():
    def optimum(sizes, capacity):
        best = [len(sizes)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= capacity:
                    place(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
            place(i + 1, [*bins, sizes[i]])

        place(0, [])
        return best[0]

    rnd = random.Random(8)
    for _ in range(60):
        sizes = sorted((rnd.randrange(5, 40) for _ in range(9)), reverse=True)
        got = packing.bin_completion(Counter(sizes), 50)
        assert Counter(s for p, t in got for s in p * t) == Counter(sizes) and all(sum(p) <= 50 for p, _ in got)
        assert sum(t for _, t in got) == optimum(sizes, 50)


@pytest.mark.parametrize("bins, pieces, nodes", [(40, (2, 5), 20_000), (40, (3, 8), 20_000), (40, (4, 4), 20_000)])
def test_bin_completion_solves_planted_packings(bins, pieces, nodes):
    for seed in range(4):
        rnd = random.Random(seed)
        sizes = []
        for _ in range(bins):
            cuts = sorted(rnd.sample(range(1, 4096), rnd.randint(*pieces) - 1))
            sizes += [b - a for a, b in zip([0, *cuts], [*cuts, 4096], strict=True)]
        got, proven = packing.search(Counter(sizes), 4096, nodes)
        assert Counter(s for p, t in got for s in p * t) == Counter(sizes) and all(sum(p) <= 4096 for p, _ in got)
        assert sum(t for _, t in got) == bins and proven


def triplets(seed, bins, capacity=4096):
    rnd = random.Random(seed)
    sizes = []
    for _ in range(bins):
        a = rnd.randint(int(0.38 * capacity), int(0.49 * capacity))
        b = rnd.randint(capacity // 4, (capacity - a) // 2)
        sizes += [a, b, capacity - a - b]
    return Counter(sizes)


def test_bin_completion_beats_best_fit():
    for seed in range(3):
        sizes = triplets(seed, 30)
        got, proven = packing.search(sizes, 4096)
        assert sum(t for _, t in got) == 30 and proven and sum(t for _, t in packing.best_fit_decreasing(sizes, 4096)) > 32
    assert packing.search({4096 // 3 + 1: 30, 5: 7}, 4096)[1]  # proven by the bound for large pieces
    got, proven = packing.search(triplets(0, 40), 4096, nodes=3)
    assert not proven and sum(t for _, t in got) >= 40


def test_packing_beats_best_fit(spark):
    sizes = triplets(1, 12, 128)
    rows = [(i, " ".join(["the"] * (n - 1))) for i, n in enumerate(sizes.elements())]
    got = packing.pack(make(spark, rows), tokenizer_path(), capacity=128).collect()
    assert Counter(r.length for r in got) == sizes and all(r.optimal for r in got)
    assert check_places(got, 128) == 12 < sum(t for _, t in packing.best_fit_decreasing(sizes, 128))


def test_tokens_of_long_and_unspaced_texts_are_not_held():
    with open(tokenizer_path(), encoding="utf-8") as f:
        tok = packing.CachedTokenizer(f.read(), cache_bytes=20_000)
    for k in range(200):
        list(tok.ids(["\u6f22" * (2000 + k), "x" * 5000, " ".join(f"w{k}q{j}" for j in range(50))]))
    for held in (tok.latin, tok.other):
        assert all(len(w) <= held.LONGEST for w in [*held, *held.old]) and held.size <= held.most <= 20_000


# --- 8


def test_url_filter(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    by_url = {r.page_id: r.url for r in pages.collect()}
    rows = url_filter.judge(pages).collect()
    assert len(rows) == len(by_url)
    for r in rows:
        rest = by_url[r.page_id].split("://", 1)[1]
        host, path = re.match(r"[^/?#]*", rest)[0].lower(), re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, r.verdict))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict) and r.verdict in ("allow", "block")


def test_url_filter_learns_and_survives(spark):
    rows = [(i, f"http://news{i}.com/story/{i}") for i in range(60)] + [(100 + i, f"http://pills{i}.net/es/cheap-pills/{i}") for i in range(60)]
    rows += [(300, "http://news7.org/story/8"), (301, "http://pills9.org/x/cheap-pills/3"), (302, None), (303, "no scheme"), (304, "HTTP://WWW.EXAMPLE.COM/en/?q#f"), (305, "x://a.net"), (305, "x://a.net"), (None, "http://b.com"), (306, "http://u.org/" + "a/" * 4000)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(i, u, 1) for i, u in rows], "page_id long, url string, host int")).collect()}
    assert got[300].verdict == "allow" and got[301].verdict == "block" and (got[302].host, got[303].path) == ("", "")
    assert got[304].rule == "www.example.com/en/" and got[304].path == "/en/" and got[None].rule is None
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty).count() == 0


def plain_witten_bell(texts_, order):
    """log-likelihood by the recursive definition, from n-gram lists."""
    grams = Counter(("\x02" * order + t)[i - k : i + 1] for t in texts_ for i in range(order, len(t) + order) for k in range(order + 1))
    after = defaultdict(dict)
    for g, n in grams.items():
        after[g[:-1]][g[-1]] = n

    def p(context, c):
        lower = p(context[1:], c) if context else 1 / 256
        if context not in after:
            return lower
        x = after[context]
        return (x.get(c, 0) + len(x) * lower) / (sum(x.values()) + len(x))

    return lambda t: sum(np.log(p(("\x02" * order + t)[i : i + order], t[i])) for i in range(len(t)))


def test_url_ratio_against_definition(spark):
    rnd = random.Random(12)
    rows = [(i, f"http://news{rnd.randrange(99)}.com/story/{rnd.randrange(999)}?a={i}") for i in range(40)] + [(100 + i, f"http://pills{rnd.randrange(99)}.net/es/cheap/{rnd.randrange(999)}#b{i}") for i in range(40)]
    rows += [(200 + i, f"ftp://x{i}.org/{'story' if i % 2 else 'cheap'}/{rnd.randrange(999)}?q={i}") for i in range(20)] + [(300, "no scheme at all"), (301, None), (302, "http://u.org/" + "story/" * 300)]
    by = dict(rows)
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    key = {u: h for u, h in spark.createDataFrame(rows, "page_id long, url string").selectExpr("url", "xxhash64(url)").collect() if u}
    sides = []
    for verdict in ("allow", "block"):
        urls = sorted({by[i] for i, r in got.items() if r.rule and r.verdict == verdict}, key=lambda u: (key[u], u))
        sides.append((urls, plain_witten_bell([u for i, u in enumerate(urls) if i % 4], 5)))
    ratio = lambda u: (sides[0][1](u) - sides[1][1](u)) / max(len(u), 1)
    free = {i: r for i, r in got.items() if r.rule is None}
    assert len(free) == 23
    for i, r in free.items():
        assert abs(r.score - ratio(by[i] or "")) < 1e-9
    held = [(ratio(u), side == 0) for side, (urls, _) in enumerate(sides) for i, u in enumerate(urls) if i % 4 == 0]
    error = lambda cut: np.mean([s < cut for s, good in held if good]) + np.mean([s >= cut for s, good in held if not good])
    least = min(error(c) for c in [s for s, _ in held])
    cut = max((r.score for r in free.values() if r.verdict == "block"), default=-9), min((r.score for r in free.values() if r.verdict == "allow"), default=9)
    assert cut[0] < cut[1] and error(cut[1]) <= least + 0.35  # one cut parts the verdicts, and it is a good one


def plain_cut(held):
    """Of (score, good): least sum of error rates, then nearest 0, over midpoints of neighbouring scores."""
    scores, good, bad = sorted({s for s, _ in held}), sorted(s for s, g in held if g), sorted(s for s, g in held if not g)
    cuts = [scores[0], *((a + b) / 2 for a, b in zip(scores, scores[1:], strict=False))]
    errors = [bisect_left(good, c) * len(bad) + (len(bad) - bisect_left(bad, c)) * len(good) for c in cuts]
    return min(zip(errors, map(abs, cuts), cuts, strict=True))[2]


def test_url_models_and_cut_come_from_every_labelled_url(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeo\U0001f600\u00e9") for _ in range(4))
    good, bad = [f"a://{word()}{i}.com/" for i in range(4_300)], [f"a://{word()}.net/es/{i}" for i in range(4_200)]
    free = [f"b://{word()}{'.net/es' if i % 2 else '.co'}{i}" for i in range(90)] + ["\x02\n", "\U0001f600" * 9, ""]
    rows = list(enumerate(good + bad + bad[:500] + free + free[:3]))  # repeated rows count once
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(rows)
    key = {r.url: r.h for r in pages.selectExpr("url", "xxhash64(url) h").collect()}
    sides = [sorted(urls, key=lambda u: (key[u], u)) for urls in (good, bad)]
    a, b = (plain_witten_bell([u for i, u in enumerate(urls) if i % 4], 5) for urls in sides)
    ratio = lambda u: (a(u) - b(u)) / max(len(u), 1)
    cut = plain_cut([(ratio(u), side == 0) for side, urls in enumerate(sides) for u in urls[::4]])
    verdicts = Counter()
    for i, u in rows:
        if got[i].rule is None:
            assert abs(got[i].score - ratio(u)) < 1e-9
            assert got[i].verdict == ("allow" if ratio(u) >= cut else "block") or abs(ratio(u) - cut) < 1e-9
            verdicts[got[i].verdict] += 1
        else:
            assert got[i].score is None
    assert sum(verdicts.values()) == len(free) + 3 and min(verdicts["allow"], verdicts["block"]) > 20


@pytest.mark.parametrize("seed", range(4))
def test_url_cut_is_the_best_of_all(spark, seed):
    rnd = random.Random(seed)
    held = [(rnd.randrange(-40, 60) / 16, rnd.random() < 0.6) for _ in range(300)] + [(1.0, True), (-1.0, False)]
    held = [(s, g) for s, g in held if seed != 3 or s > 0]
    df = spark.createDataFrame([*held, (0.5, True), (0.25, False)], "score double, good boolean")
    assert url_filter.calibrate(df) == plain_cut([*held, (0.5, True), (0.25, False)])


def test_char_model_is_a_distribution():
    m = url_filter.CharModel(3)
    m.add("abab")
    m.add("abc")
    m.freeze()
    total = sum(np.exp(m.log_likelihood("ab" + c) - m.log_likelihood("ab")) for c in map(chr, range(256)))
    assert abs(total - 1) < 1e-9


# --- 9


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in fingerprints.fingerprint(docs, rows_per_bucket=7).collect()}
    order = sorted(texts, reverse=True)
    one = lambda t: set(fingerprints.paragraph_digests(*utf8(t))[0].tolist())
    for i, d in enumerate(order):
        t, nxt = texts[d], texts[order[(i + 1) % len(order)]]
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        for have, other in ((got[d].near_edited, e), (got[d].near_next, nxt)):
            a, b = one(t), one(other)
            assert abs(have - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12
    prints = defaultdict(set)
    for d in order:
        prints[texts[d]].add(got[d].fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def utf8(t):
    import pyarrow as pa

    from lodestone.llm._common import utf8_parts

    return utf8_parts(pa.array([t], pa.large_string()))


def test_fingerprints_awkward(spark):
    got = fingerprints.fingerprint(make(spark, AWKWARD), rows_per_bucket=2).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in AWKWARD)
    assert fingerprints.fingerprint(make(spark, [(1, "a b")])).first().near_next == 1.0
    assert fingerprints.fingerprint(make(spark, [])).count() == 0


def test_fingerprints_of_many_rows_without_id(spark):
    rows = [(None, f"text number {i} of those without an id, and a few words more") for i in range(50)] + [(5, f"five {i}") for i in range(9)] + [(9, "nine")]
    got = fingerprints.fingerprint(make(spark, rows), rows_per_bucket=4).collect()
    key = {t: h & 0xFFFFFFFFFFFFFFFF for t, h in make(spark, rows).selectExpr("text", "xxhash64(text)").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), key[r[1]] >> 32, r[1]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        edited = fingerprints.edited_text(t, order[(k + 1) % len(order)][1])
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want


def test_peeling_recovers_differences():
    rnd = np.random.default_rng(3)
    a = [rnd.integers(0, 2**63, n).astype(np.uint64) for n in (0, 1, 5, 400)]
    b = [np.concatenate((x[: len(x) // 2], rnd.integers(0, 2**63, 3).astype(np.uint64))) for x in a]
    flat = lambda s: (np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s]))
    assert fingerprints.differing(flat(a), flat(b), 4).tolist() == [len(set(x.tolist()) ^ set(y.tolist())) for x, y in zip(a, b, strict=True)]


# --- 1


def test_revisits(spark):
    row = lambda i, ts, url, kind, etag=None, digest=None, headers=None, mod=None: (i, ts, url, kind, 200 if kind == "response" else 304, etag, mod, digest, headers)
    rows = [
        row(1, 10, "http://www.A.com/x/?b=2&a=1&utm_source=q#top", "response", "e1", "d1", {"Content-Length": "5", "Age": "0"}), row(2, 20, "https://a.com:443/x?a=1&b=2", "revisit", "W/e1", None, {"content-length": "0", "AGE": "9"}),
        row(3, 30, "http://a.com/x?a=1&b=2", "response", "e2", "d2", None), row(4, 40, "http://a.com/x?a=1&b=2", "revisit", "e1"), row(5, 5, "http://a.com/x?a=1&b=2", "revisit", "e1"),
        row(6, 30, "http://a.com/x?a=1&b=2", "revisit", "e1"), row(7, 50, "http://a.com/x?a=1&b=2", "revisit"), row(8, None, "http://a.com/", "revisit", "e"), row(9, 9, None, "revisit"), row(10, 1, "http://b.com", "request"),
        row(4, 40, "http://a.com/x?a=1&b=2", "revisit", "e1"),
    ]
    got = defaultdict(list)
    for r in warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD).withColumn("last", F.lit(1)).withColumn("block", F.lit(1))).collect():
        got[r.record_id].append(r)
    outcome = {i: (r[0].response_id, r[0].outcome) for i, r in got.items()}
    assert outcome == {2: (1, "resolved"), 4: (3, "mismatch"), 5: (None, "no_response"), 6: (1, "resolved"), 7: (3, "unchecked"), 8: (None, "no_response"), 9: (None, "no_response")}
    assert got[2][0].headers == {"age": "9", "content-length": "5"} and got[2][0].digest == "d1" and len(got[4]) == 2
    assert warc.resolve_revisits(spark.createDataFrame([], warc.RECORD)).count() == 0


def test_revisits_with_names_that_differ_in_case(spark):
    row = lambda i, ts, url, kind, headers: (i, ts, url, kind, 200, "e", None, None, headers)
    rows = [row(1, 1, "http://a.com/", "response", {"Age": "0", "age": "1", "Etag": "e", "Content-Type": "t"}), row(2, 2, "http://a.com/", "revisit", {"Age": "5", "AGE": "7", "Content-TYPE": "x", "content-type": "y"})]
    rows += [row(3, 1, "http://#x", "response", {}), row(4, 2, "#y", "revisit", {}), row(5, 3, "", "revisit", {}), row(6, 3, "http://a.com/" + "p/" * 5000, "revisit", {"x": "y" * 50_000})]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert got[2].headers == {"age": "7", "content-type": "t", "etag": "e"}
    assert [got[i].outcome for i in (4, 5, 6)] == ["no_response"] * 3


def test_revisits_match_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    got = warc.revisit_report(spark.read.parquet(f"{sf}/pages.parquet")).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.execute(warc.ORACLE_SQL).df()
    clean = lambda d: [[None if x is None or x != x else str(x) for x in r] for r in d[sorted(want.columns)].astype({"response_id": "Int64", "status": "Int64"}).astype(object).where(lambda y: y.notna(), None).values.tolist()]
    key = lambda rows: sorted(map(str, rows))
    assert key(clean(got)) == key(clean(want))


from pyspark.sql import functions as F  # noqa: E402
