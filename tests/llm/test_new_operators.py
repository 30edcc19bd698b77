"""Conversation repair, importance resampling and nearest neighbours against plain Python, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name,tables", [("op11_importance_resampling", ("documents", "benchmark")), ("op13_conversation_repair", ("conversations",))])
def test_query_equals_its_sql(spark, name, tables):
    from tessera.llm import queries as q

    df = q.QUERIES[name](spark, DATA)
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(q.ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r) for r in df.select(cols).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# Conversation repair


def _faults(rows):
    seen, out = set(), []
    for role, text in rows:
        core = text.rstrip(SPACE)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def _cheapest(rows, faults):
    """Every way to keep, rerole or delete each row with up to two insertions anywhere, tried out."""
    gaps = [""] + list("ua") + ["ua", "au", "uu", "aa"]
    choices = []
    for (role, _), fault in zip(rows, faults, strict=True):
        late = int(fault == "truncated")
        moves = [(3, "D", "")]
        if fault not in ("blank", "duplicate"):
            moves += [(late, "K", role[:1] or "?"), (2 + late, "R", "u"), (2 + late, "R", "a")]
        choices.append(moves)
    best = None
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        cost = 2 * sum(map(len, inserts))
        if best and cost > best[0]:
            continue
        for moves in itertools.product(*choices):
            roles = "".join(g + m[2] for g, m in zip(inserts, [*moves, (0, "", "")], strict=True))
            if re.fullmatch("(s?(ua)+)?", roles):
                audit = "".join("I" * len(g) + m[1] for g, m in zip(inserts, [*moves, (0, "", "")], strict=True))
                best = min(best or (10**9, ""), (cost + sum(m[0] for m in moves), audit))
    return best


def _repaired(rows, audit):
    """Roles alternate after a leading s, so the audit says them all."""
    left, lines = iter(rows), []
    lead = len(audit.replace("D", "")) % 2
    for letter in audit:
        row = next(left) if letter != "I" else ("", "")
        if letter != "D":
            own = ("user", "assistant")[(len(lines) - lead) % 2]
            lines.append(f"{row[0] if letter == 'K' else own}:{row[1]}")
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _conversations(r, n):
    texts = ["Yes.", "no", "", " \t", "What?", "Well. ", "x!"]
    return {i: [(r.choice(["user", "assistant", "system", "tool", "", "User"] if i % 2 else ["user", "assistant", "system"]), r.choice(texts)) for _ in range(r.randrange(1, 4))] for i in range(n)}


def test_repair_equals_every_way_to_edit(spark):
    from tessera.llm.turn_repair import repair

    convs = _conversations(random.Random(4), 60)
    rows = [(i, k, role, text) for i, c in convs.items() for k, (role, text) in enumerate(c)]
    got = {x.conv_id: x for x in repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("clash"))).collect()}
    assert len(got) == len(convs)
    for i, c in convs.items():
        faults = _faults(c)
        assert (got[i].cost, got[i].audit) == _cheapest(c, faults), (c, got[i])
        assert got[i].repaired_sha256 == _repaired(c, got[i].audit)
        assert [got[i][f] for f in ("blank", "duplicate", "truncated")] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        assert got[i].illegal == sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(c))


def _by_state(rows):
    """(cost, audit) by a fold in one piece."""
    never = 1 << 40
    a = [(0, ""), (never, ""), (never, ""), (never, "")]
    add = lambda s, c, t: (s[0] + c, s[1] + t)
    opened = lambda a: [a[0], a[1], min(a[2], *[add(a[i], 2, "I") for i in (0, 1, 3)]), min(a[3], add(a[2], 2, "I"), add(a[0], 4, "II"), add(a[1], 4, "II"))]
    for (role, _), fault in zip(rows, _faults(rows), strict=True):
        a = opened(a)
        new = [add(x, 3, "D") for x in a]
        if fault not in ("blank", "duplicate"):
            late = int(fault == "truncated")
            for state, froms in (("s", (0,)), ("u", (0, 1, 3)), ("a", (2,))):
                to = {"s": 1, "u": 2, "a": 3}[state]
                for f in froms:
                    if role[:1] == state:
                        new[to] = min(new[to], add(a[f], late, "K"))
                    elif state != "s":
                        new[to] = min(new[to], add(a[f], 2 + late, "R"))
        a = new
    return min(opened(a)[0], opened(a)[3])


def test_long_conversations_are_folded_in_chunks(spark, monkeypatch):
    from tessera.llm import turn_repair

    monkeypatch.setattr(turn_repair, "CHUNK", 4)
    monkeypatch.setattr(turn_repair, "FAN", 3)
    r = random.Random(9)
    convs = {i: [(r.choice(["user", "assistant", "system"]), r.choice(["a.", "b.", "c", "", "d!", f"{k}."])) for k in range(n)] for i, n in enumerate([1, 4, 5, 13, 60, 150])}
    rows = [(i, k, *x) for i, c in convs.items() for k, x in enumerate(c)]
    r.shuffle(rows)
    got = {x.conv_id: x for x in turn_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    for i, c in convs.items():
        assert (got[i].cost, got[i].audit) == _by_state(c)
        assert got[i].repaired_sha256 == _repaired(c, got[i].audit) and got[i].gaps == 0
        assert [got[i][f] for f in ("blank", "duplicate", "truncated")] == [_faults(c).count(f) for f in ("blank", "duplicate", "truncated")]
        assert got[i].illegal == sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(c))


def test_repair_of_nulls_ties_and_empty_tables(spark):
    from tessera.llm.turn_repair import damage, repair

    kind = "conv_id long, turn long, role string, text string"
    long = "word " * 50_000
    rows = [(1, None, "system", "Be."), (1, 5, "user", "Hi."), (1, 2, None, "x"), (1, 9, "assistant", None), (None, 1, "user", "A."), (None, 1, "user", "A."), (None, 4, "assistant", "B."), (3, None, "user", long + ".")]
    got = {x.conv_id: x for x in repair(spark.createDataFrame(rows, kind)).collect()}
    assert (got[1].gaps, got[1].blank, got[1].truncated) == (5, 1, 1) and (got[None].gaps, got[None].duplicate, got[None].audit) == (2, 1, "KDK")
    assert (got[3].gaps, got[3].audit) == (0, "KI") and got[3].repaired_sha256 == hashlib.sha256(f"user:{long}.\nassistant:".encode()).hexdigest()
    gone = next((c, t) for c in range(99) for t in range(99) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    only = spark.createDataFrame([(*gone, "user", "Hi.")], kind)
    row = repair(damage(only), only).first()
    assert (row.conv_id, row.cost, row.audit, row.repaired_sha256) == (gone[0], 0, "", hashlib.sha256(b"").hexdigest())
    empty = spark.createDataFrame([], kind)
    assert repair(damage(empty), empty).count() == 0


# Importance resampling


def _ngrams(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("ngram", [1, 3])
def test_byte_automaton_equals_regular_expressions(ngram):
    from tessera.llm.importance import features

    r = random.Random(ngram)
    texts = ["", "a", "é", "A-B", "x" * 200 + " y", "日本 語0", "\x00a\x7fb", "ab", "cd", " ", "Zz{q"] + ["".join(r.choice("aB9 é.日𝄞\n") for _ in range(r.randrange(40))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    words, text, crc = features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(b) for b in raw]), ngram)
    got = [sorted(crc[text == i].tolist()) for i in range(len(texts))]
    assert words.tolist() == [len(_ngrams(t, ngram)[0]) for t in texts]
    assert got == [sorted(zlib.crc32(g.encode()) for g in _ngrams(t, ngram)[1]) for t in texts]


def test_resampling_equals_plain_python(spark, monkeypatch):
    from tessera.llm import importance

    monkeypatch.setattr(importance, "BLOCK", 300)
    r = random.Random(5)
    word = lambda: r.choice(["The", "cat", "été", "日本", "run", f"w{r.randrange(60)}"])
    rows = [(i, " ".join(word() for _ in range(r.choice([5, 19, 20, 60])))) for i in range(120)] + [(500, None), (501, ""), (None, "x " * 30), (7, "again " * 25), (7, "again " * 25), (600, "long" * 5000)]
    goal = [" ".join(word() for _ in range(50)) for _ in range(5)] + [None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    target = spark.createDataFrame([(g,) for g in goal], "text string")
    for ngram in (1, 2):
        got = importance.resample(docs, target, ngram=ngram, percent=30).collect()
        s, t = [0] * 10_000, [0] * 10_000
        for table, texts in ((s, [x for _, x in rows]), (t, goal)):
            for x in texts:
                for g in _ngrams(x, ngram)[1]:
                    table[zlib.crc32(g.encode()) % 10_000] += 1
        gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t, strict=True)]
        want = []
        for i, x in rows:
            words, grams = _ngrams(x, ngram)
            weight = sum(gain[zlib.crc32(g.encode()) % 10_000] for g in grams)
            h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
            want.append((i, len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
        may = sorted((x for x in want if x[4] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1]))
        drawn = [x[:4] for x in may[: 30 * len(may) // 100]]
        assert sorted((tuple(x)[:4] for x in got), key=repr) == sorted((x[:4] for x in want), key=repr)
        assert [tuple(x)[:4] for x in sorted((x for x in got if x.rank), key=lambda x: x.rank)] == drawn and {x.rank for x in got if x.rank} == set(range(1, len(drawn) + 1))
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, target).count() == 0
    assert all(x.n_features == 0 or x.weight != 0 for x in importance.resample(docs, none.select("text")).collect() if x.doc_id != 500)


# Nearest neighbours


def _search(spark, rows, **options):
    from tessera.llm.nearest import search, usable
    from tessera.plans.scratch import Scratch

    scratch = Scratch(spark)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("clash"))
    every = scratch.save(usable(df), "usable")
    out = {}
    for x in search(every.where("vec_id % 100 = 0"), every, scratch, **options).collect():
        out.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    return {q: [(v, s) for _, v, s in sorted(xs)] for q, xs in out.items()}


def _exact(rows, q, k=10):
    x = np.float32(rows[q]).astype(float)
    far = sorted((float(np.sqrt(((np.float32(v).astype(float) - x) ** 2).sum())), i) for i, v in rows.items() if i != q)
    return [(i, s) for s, i in far[:k]]


def test_nearest_neighbours_recall(spark, monkeypatch):
    from tessera.llm import nearest

    monkeypatch.setattr(nearest, "CELL", 20)  # a longer hash of two turns
    monkeypatch.setattr(nearest, "ROWS", 150)
    monkeypatch.setattr(nearest, "QUERIES", 8)
    g = np.random.default_rng(1)
    centres = g.normal(size=(30, 24)) * 3
    x = centres[g.integers(0, 30, 3000)] + g.normal(size=(3000, 24))
    x[1000:2000] = x[1000] + 1e-3 * g.normal(size=(1000, 24))  # a third of all in one cell
    rows = dict(enumerate(np.float32(x).tolist()))
    got = _search(spark, list(rows.items()))
    hits = [len({v for v, _ in got[q]} & {v for v, _ in _exact(rows, q)}) for q in range(0, 3000, 100)]
    assert sum(hits) >= 0.9 * 10 * len(hits) and all(len(got[q]) == 10 for q in got) and len(got) == 30
    for q, found in got.items():
        assert all(abs(s - np.linalg.norm(np.float64(np.float32(rows[v])) - np.float64(np.float32(rows[q])))) < 1e-12 for v, s in found)


def test_nearest_neighbours_of_few_equal_and_unusable_vectors(spark):
    e = lambda i: [float(i == k) for k in range(4)]
    bad = [(5, None), (6, [0.0] * 4), (7, [1.0, None, 0.0, 0.0]), (8, [float("nan")] * 4), (9, [float("inf"), 0.0, 0.0, 0.0]), (10, [1.0]), (None, e(1))]
    got = _search(spark, [(100, e(0)), (1, e(1)), (2, e(0)), (3, e(0)), (3, e(0)), (4, [2.0, 0.0, 0.0, 0.0]), *bad])
    assert got == {100: [(2, 0.0), (3, 0.0), (4, 1.0), (1, math.sqrt(2))]}
    same = _search(spark, [(i, e(0)) for i in range(300)])
    assert all([v for v, _ in same[q]] == [i for i in range(12) if i != q][:10] for q in (0, 100, 200))
    assert _search(spark, []) == {} and _search(spark, [(0, e(0))]) == {}


def test_probes_come_in_order_of_likelihood():
    from tessera.llm import nearest

    x = np.random.default_rng(3).normal(size=(20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    widths = (16, 4)
    order = nearest.likeliest(x, 1, widths, 2 * 16 * 2 * 4)
    assert (order[:, 0] == nearest.cells(x, 1, widths)).all() and all(sorted(o) == list(range(256)) for o in order.tolist())
    turned = nearest._turned(x, 5)
    assert np.allclose((turned**2).sum(1), 1) and np.allclose(turned @ turned.T, x @ x.T)
    assert nearest.widths_for(51_282, 64) == (64,) and nearest.widths_for(10**9, 64) == (64, 64, 64)


def test_pattern_rules_equal_every_regex_on_every_url(spark):
    from tessera.llm import url_filter

    assert all(r.tokens for r in url_filter.RULES)
    r = random.Random(7)
    part = lambda: r.choice(["casino", "casinos", "my-casino", "casino-x", "xcasino", "pills", "a-pills", "ads-track", "adult-x", "porn", "b", "casino_1", "cas"])
    urls = [f"http://{r.choice(['', 'www.', 'a.'])}{part()}.{r.choice(['org', 'casino.org', 'x-casino.io'])}/{part()}{r.choice(['', '/', '/' + part()])}" for _ in range(400)]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    for x in got:
        hits = [rule for rule in url_filter.RULES if re.search(rule.regex, x.host + x.path)]
        own = [rule for rule in hits if rule.host_rule]
        best = max(own or hits, key=lambda rule: len(rule.text), default=None)
        assert x.verdict == (best.verdict if best else "allow") and x.rule == (best.text if own else None)
    assert {x.verdict for x in got} == {"allow", "block"}
