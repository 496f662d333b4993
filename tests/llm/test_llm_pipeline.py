"""The pipeline on the smallest tables against plain Python, stage by stage."""

import collections
import math
import re
import zlib

import pytest

import corpus_pipeline
from keystrand.llm import mixing, quality, queries

DIR = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def bad_lines(x):
    """For each line whether it fails a rule; words in all, in failing lines and in repeated windows."""
    w = SPACE.findall(x)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) for k in range(3) if grams[tuple(w[i : i + 3])] > 1}
    at, lost, out = 0, 0, []
    for line in x.split("\n"):
        v = SPACE.findall(line)
        n, up, small = len(v), len(re.findall("[A-Z]", line)), len(re.findall("[a-z]", line))
        bad = n and (
            10 * len(re.findall(r"[#*$%&|<>]", line)) > n
            or (up + small >= 10 and 2 * up > up + small)
            or (n <= quality.SHORT_LINE and v[-1][-1] not in quality.TERMINAL + quality.TERMINAL_WIDE)
            or (n >= 10 and 2 * sum(i in covered for i in range(at, at + n)) > n)
            or any(p.decode() in line.translate(LOWER) for p in quality.BOILERPLATE)
        )
        lost += n if bad else 0
        at += n
        out.append(bool(bad))
    return out, len(w), lost, len(covered)


def quality_kept(x):
    _, n, lost, covered = bad_lines(x)
    return n >= 50 and 100 * covered <= 50 * n and lost <= quality.MAX_LOST * n


def without_bad_lines(x):
    return "\n".join(s for s, bad in zip(x.split("\n"), bad_lines(x)[0]) if not bad)


def one_of_each(rows, k=5, percent=80):
    sets = []
    for i, x in rows:
        w = SPACE.findall(x.translate(LOWER))
        sets.append((i, {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())))
    label = {i: i for i, _ in sets}

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [(i, x) for i, x in rows if find(i) == i]


def clean_of(rows, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for x in items:
        b = word.findall(x.translate(LOWER))
        n = min(10, len(b))
        if n:
            windows[n] |= {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    out = []
    for i, x in rows:
        w = word.findall(x.translate(LOWER))
        if not any(tuple(w[a : a + n]) in s for n, s in windows.items() for a in range(len(w) - n + 1)):
            out.append((i, x))
    return out


def features(x):
    every = [w for w in re.split(mixing.BETWEEN, x.lower()) if w]
    n, words = len(every), set(every)
    cap, sym = len(re.findall("[A-Z]", x)), len(re.findall(r"[#*$%&|<>]", x))
    return n, words | {m for m, on in (("#symbols", 5 * sym > n), ("#capitals", 4 * cap > len(x)), ("#repeats", n >= 20 and 4 * len(words) < n)) if on}


def mixed(rows, labels):
    """The same model and descent in plain floating point."""
    known = {}
    for i, q, t in labels:
        known[i] = max(known.get(i, 0), 2 if t == 1 else 1 if q == 0 else 0)
    have = {i: features(x) for i, x in rows}
    size = [sum(known.get(i) == k for i in have) for k in range(3)]
    total = sum(size)
    prior = [math.log((n + 0.5) / (total + 1.5)) for n in size]
    counts = collections.defaultdict(lambda: [0, 0, 0])
    for i, (_, f) in have.items():
        if i in known:
            for w in f:
                counts[w][known[i]] += 1
    none, base, weights = [], [], []
    for k in (1, 2):
        scored = []
        for w, c in counts.items():
            lift = (c[k] + 0.5) / (size[k] + 1) / ((sum(c) - c[k] + 0.5) / (total - size[k] + 1))
            if sum(c) >= mixing.LEAST_DOCS and c[k] >= max(mixing.LEAST_DOCS, mixing.LEAST_SHARE * size[k]) and lift >= mixing.LIFT:
                scored.append((-c[k] * math.log(lift), w.encode()))
        names = [w.decode() for _, w in sorted(scored)[: mixing.MAX_FEATURES]]
        odds, mine = math.log((size[k] + 0.5) / (size[0] + 0.5)) if size[k] else -30.0, {}
        lacking = collections.Counter(known[i] for i, (_, f) in have.items() if i in known and not f & set(names))
        p, q = (lacking[k] + 0.5) / (size[k] + 1), (sum(lacking.values()) - lacking[k] + 0.5) / (total - size[k] + 1)
        none.append(odds + math.log(p / q))
        for w in names:
            p = (counts[w][k] + 0.5) / (size[k] + 1)
            q = (sum(counts[w]) - counts[w][k] + 0.5) / (total - size[k] + 1) + mixing.STRAY / len(names)
            odds += math.log((1 - p) / (1 - q))
            mine[w] = math.log(p / (1 - p)) - math.log(q / (1 - q))
        base.append(odds)
        weights.append(mine)
    post = {}
    for i, (n, f) in have.items():
        odds = [math.exp(min(50, b + sum(w.get(x, 0) for x in f) if f & w.keys() else a)) for a, b, w in zip(none, base, weights)]
        p = [round(o / (1 + sum(odds)), 4) for o in odds]
        post[i] = n, [round(1 - sum(p), 4), *p]
    rate = dict.fromkeys(post, 1.0)
    mass = [sum(n * p[k] for n, p in post.values()) for k in range(3)]
    goal = [mass[0] / 0.98 * s for s in (0.98, 0.02, 0.0)]
    slope: list[float] = []
    for _ in range(mixing.STEPS):
        now = [sum(n * rate[i] * p[k] for i, (n, p) in post.items()) for k in range(3)]
        if all(abs(a - b) <= mixing.CLOSE * (b or mass[0] / 0.98) for a, b, m in zip(now, goal, mass) if m > 0):
            break
        slope, last = [(a - b) / m if m > 0 else 0.0 for a, b, m in zip(now, goal, mass)], slope
        if last and max(abs(x - y) for x, y in zip(slope, last)) < mixing.STILL:
            break
        rate = {i: max(0.0, r - (sum(e * v for e, v in zip(slope, post[i][1])) + mixing.RIDGE * (r - 1)) / (1 + mixing.RIDGE)) for i, r in rate.items()}
    else:
        raise AssertionError("the rates do not settle")
    return {i: 1.0 if post[i][1][0] >= mixing.CLEAN else r for i, r in rate.items()}


def drawn(spark, rows, rate):
    """Each row as often as its rate and the hash of id and text say."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    share = F.pmod(F.xxhash64(F.lit("copies"), F.xxhash64("doc_id", "text")), F.lit(1 << 32)) / (1 << 32)
    return sorted((r["doc_id"], r["text"]) for r in df.withColumn("u", share).collect() for _ in range(int(rate[r["doc_id"]] + r["u"])))


def test_pipeline(spark):
    from tokenizers import Tokenizer

    read = lambda t, *c: [tuple(r) for r in queries.table(spark, DIR, t).select(*c).collect()]
    rows = sorted(read("documents", "doc_id", "text"))
    want = [[(i, without_bad_lines(x)) for i, x in rows if quality_kept(x)]]
    want.append(one_of_each(want[-1]))
    want.append(clean_of(want[-1], [x for (x,) in read("benchmark", "text")]))
    want.append(drawn(spark, want[-1], mixed(want[-1], read("labels", "doc_id", "quality", "toxic"))))
    docs = queries.table(spark, DIR, "documents")
    columns = docs.columns
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], want):
        docs = stage(spark, docs, DIR)
        assert docs.columns == columns
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == expected, name
        assert docs.where("n_chars <> length(text)").isEmpty()
    tokenizer, at, last = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json")), 0, []
    for i, x in want[-1]:
        ids = [*tokenizer.encode(x, add_special_tokens=False).ids, 1]
        last.append((i, at, len(ids), zlib.crc32(b"".join(v.to_bytes(4, "little") for v in ids))))
        at += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, DIR).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == last


def test_stages_take_empty_tables(spark):
    docs = queries.table(spark, DIR, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        assert out.count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import glob
    import os

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    df = queries.QUERIES[name](spark, DIR)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(got.fetchall())
