"""Secret scan with DataFrame functions alone: candidates by pattern, false positives removed by a random forest.

The forest is trained on the driver from a bounded set of labelled findings (before, candidate, after, label) and then
written as one expression of nested conditions, so scoring stays in the JVM.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{12,}={0,2}"
CONTEXT = 60
TREES, DEPTH, LEAST_LEAF, MAX_FINDINGS = 15, 5, 4, 6000
THRESHOLD = 0.5
#: Fixed word lists of the features.
DICTIONARY = (
    "example", "sample", "test", "dummy", "placeholder", "changeme", "your", "here", "insert", "password", "secret", "token", "key", "api", "user",
    "name", "file", "image", "index", "page", "version", "build", "release", "config", "data", "value", "default", "none", "null", "true", "false",
    "abc", "xyz", "foo", "bar", "xxx", "000", "123", "the", "and", "for", "with", "src", "lib", "bin", "usr", "home", "http", "www", "com", "org",
)
KEY_WORDS = r"(?i)(passw|passwd|pwd|secret|token|api.?key|apikey|auth|credential|bearer|access.?key|private)"
HASH_WORDS = r"(?i)(commit|sha-?1|sha-?256|md5|checksum|digest|hash|uuid|guid|etag|revision|example|sample|isbn|order|invoice|phone|fingerprint)"
KNOWN = r"^(AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xox[bp]-|eyJ|AIza|glpat-)"


def features(before: Column, value: Column, after: Column) -> dict[str, Column]:
    """Length, character transitions, dictionary coverage, path and neighbouring words of a candidate."""
    n = F.length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    runs = value
    for pattern, letter in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), ("[+/_=-]+", "-")):
        runs = F.regexp_replace(runs, pattern, letter)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "symbols": share("[+/_=-]"),
        "transitions": F.length(runs) / n,
        "vowel_steps": share("[aeiouAEIOU](?=[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z])"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(value), "|".join(DICTIONARY), "")) / n,
        "hex": flag(value.rlike("^[0-9a-fA-F]+$")),
        "uuid": flag(value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "path": F.regexp_count(value, F.lit("/")).cast("double") + flag(before.rlike(r"(://|[/.\\])\S*$")) + flag(after.rlike(r"^(/|\.[a-z]{1,4}\b)")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(before.rlike("[\"']$") & after.rlike("^[\"']")),
        "key_word": flag(before.rlike(KEY_WORDS)),
        "hash_word": flag(before.rlike(HASH_WORDS) | F.substring(after, 1, 20).rlike(HASH_WORDS)),
        "known": flag(value.rlike(KNOWN)),
        "number": flag(value.rlike(r"^[0-9-]+$")),
    }


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, nth, start, before, value, after) of every candidate of every whole text; start counts from 0."""
    text = F.col(text_col).cast("string")
    rows = docs.where(text.rlike(CANDIDATE)).select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("values"),
        F.split(text, CANDIDATE, -1).alias("between"),
    )
    # What stands around a candidate is cut out within the row, so that no text is carried along with every candidate.
    around = lambda v, i: F.struct(
        F.right(F.get("between", i), F.lit(CONTEXT)).alias("before"), v.alias("value"),
        F.substring(F.get("between", i + 1), 1, CONTEXT).alias("after"), F.length(F.get("between", i)).alias("gap"),
    )
    each = rows.select("doc_id", "row", F.posexplode(F.transform("values", around)).alias("nth", "c")).select("doc_id", "row", "nth", "c.*")
    # Where each candidate starts: the lengths before it in its row, which is told by its number, not by id and text.
    so_far = Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.length("value")).over(so_far) - F.length("value")
    return each.withColumn("start", start.cast("long")).drop("gap", "row")


def labelled_findings(seed: int = 11, n: int = 4000) -> list[tuple[str, str, str, int]]:
    """A generated set of labelled findings, half secrets: the default training set."""
    r = np.random.default_rng(seed)
    pick = lambda letters, k: "".join(r.choice(list(letters), int(k)))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, b64 = digit + "abcdef", lower + upper + digit + "+/"
    syllables = ["the", "an", "re", "tion", "er", "on", "ly", "de", "la", "ung", "ch", "es", "ado", "que", "ment", "ou", "in", "st"]
    word = lambda: "".join(r.choice(syllables, int(r.integers(1, 4))))
    prose = lambda: " ".join(word() for _ in range(int(r.integers(2, 8)))) + str(r.choice([" ", ", ", ". ", "\n"]))
    after = lambda: str(r.choice([" ", "\n", ", ", ""])) + word() + " " + word()
    keys = ["password", "passwd", "token", "api_key", "secret", "auth_token", "access_key", "client_secret", "PASSWORD", "apikey"]
    out = []
    for i in range(n):
        kind = i % 10
        b, a = prose(), after()
        if kind == 0:
            out.append((b, "AKIA" + pick(upper + digit, 16), a, 1))
        elif kind == 1:
            out.append((b + str(r.choice(keys)) + str(r.choice(["=", ": ", " = "])), pick(hexa, r.integers(14, 41)), a, 1))
        elif kind == 2:
            out.append((b + str(r.choice(keys)) + str(r.choice([' = "', '="', ': "'])), pick(b64 if r.random() < 0.5 else hexa, r.integers(20, 48)), '"' + a, 1))
        elif kind == 3:
            out.append((b + str(r.choice(["", "Bearer ", "token "])), str(r.choice(["ghp_", "sk_live_", "glpat-", "AIza"])) + pick(lower + upper + digit, 36), a, 1))
        elif kind == 4:
            out.append((b + str(r.choice(keys)) + str(r.choice(["=", ": "])), pick(lower, 4) + pick(digit, 3) + pick(upper, 3) + pick(b64[:62], r.integers(6, 20)), a, 1))
        elif kind == 5:
            out.append((b + str(r.choice(["commit ", "sha1 ", "md5: ", "checksum ", "digest=", "revision "])), pick(hexa, r.choice([32, 40, 64])), a, 0))
        elif kind == 6:
            h = pick(hexa, 32)
            out.append((b + str(r.choice(["", "id ", "uuid ", "request "])), f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", a, 0))
        elif kind == 7:
            path = "/".join(word() + (pick(digit, 2) if r.random() < 0.5 else "") for _ in range(4)) + pick(digit, 2)
            out.append((b + str(r.choice(["/", "https://", "src/", "./"])), path, str(r.choice([".html", ".py", "/", " "])) + a, 0))
        elif kind == 8:
            v = str(r.choice(["YOUR_API_KEY_123", "example-password-1", "xxxxxxxxxxxx0000", "insert_token_here_1", "changeme12345678", "test_secret_key_01"]))
            out.append((b + str(r.choice(keys)) + str(r.choice(["=", ": "])), v, a, 0))
        elif r.random() < 0.5:
            out.append((b + str(r.choice(["phone ", "order ", "", "isbn "])), pick(digit, 4) + "-" + pick(digit, 4) + "-" + pick(digit, 5), a, 0))
        else:
            out.append((b, word() + word() + word() + pick(digit, r.integers(1, 4)), a, 0))
    return [x if len(x[1]) >= 12 else (x[0], x[1] + "0" * 12, x[2], x[3]) for x in out]


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    p = float(y.mean())
    if depth == 0 or len(y) < 2 * LEAST_LEAF or p in (0.0, 1.0):
        return p
    best = None
    for f in rng.choice(x.shape[1], max(2, int(np.sqrt(x.shape[1]) + 1)), replace=False):
        for t in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 16))):
            left = x[:, f] <= t
            k = int(left.sum())
            if LEAST_LEAF <= k <= len(y) - LEAST_LEAF:
                a, b = y[left].mean(), y[~left].mean()
                gini = k * a * (1 - a) + (len(y) - k) * b * (1 - b)
                if best is None or gini < best[0]:
                    best = gini, int(f), float(t), left
    if best is None:
        return p
    _, f, t, left = best
    return f, t, _tree(x[left], y[left], rng, depth - 1), _tree(x[~left], y[~left], rng, depth - 1)


def sample(findings: list[tuple[str, str, str, int]], seed: int, most: int = MAX_FINDINGS) -> list[tuple[str, str, str, int]]:
    """At most ``most`` findings, drawn by label."""
    if len(findings) <= most:
        return list(findings)
    rng, out = np.random.default_rng(seed), []
    for label in (0, 1):
        mine = [f for f in findings if f[3] == label]
        share = min(len(mine), max(1, most * len(mine) // len(findings)))
        out += [mine[i] for i in sorted(rng.choice(len(mine), share, replace=False))] if mine else []
    return out


def train(spark: SparkSession, findings: list[tuple[str, str, str, int]] | None = None, seed: int = 5) -> list:
    """The forest, as nested (feature, threshold, at most, above) tuples. Of more than MAX_FINDINGS findings a seeded sample
    is used that has both labels in the proportion of all, at least one of each."""
    rows = sample(labelled_findings() if findings is None else findings, seed)
    df = spark.createDataFrame(rows, "before string, value string, after string, label int")
    cols = features(F.col("before"), F.col("value"), F.col("after"))
    data = np.array([list(r) for r in df.select(*cols.values(), F.col("label").cast("double")).collect()])
    x, y = data[:, :-1], data[:, -1]
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(TREES):
        at = rng.integers(0, len(y), len(y))
        forest.append(_tree(x[at], y[at], rng, DEPTH))
    return forest


def forest_score(forest: list, names: list[str]) -> Column:
    """Mean of the trees' leaf shares, over columns named as the features."""

    def node(t) -> Column:
        return F.lit(float(t)) if isinstance(t, float) else F.when(F.col(names[t[0]]) <= t[1], node(t[2])).otherwise(node(t[3]))

    total = F.lit(0.0)
    for t in forest:
        total = total + node(t)
    return total / len(forest)


def scan(docs: DataFrame, forest: list | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, nth, start, length, value, score, is_secret: one row per candidate of every whole text.

    Null and empty texts, and so an empty table, have none. Repeated rows give their candidates each; a null id stays null. Other
    columns, whatever their names, are passed over.
    """
    forest = train(docs.sparkSession) if forest is None else forest
    found = candidates(docs, id_col, text_col)
    cols = features(F.col("before"), F.col("value"), F.col("after"))
    tag = "f_"
    scored = found.select("doc_id", "nth", "start", "value", *[c.alias(tag + k) for k, c in cols.items()])
    score = F.round(forest_score(forest, [tag + k for k in cols]), 6)
    out = scored.select("doc_id", "nth", "start", F.length("value").cast("long").alias("length"), "value", score.alias("score"))
    return out.withColumn("is_secret", F.col("score") >= THRESHOLD)
