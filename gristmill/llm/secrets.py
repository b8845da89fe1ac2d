"""Secret scans by patterns and character Markov models, in native expressions only.

Three patterns give the base spans. The method adds runs of key characters
that two first-order Markov models tell apart: one learned from random
strings, one from ordinary identifiers, both labelled samples. Their
log-likelihood ratio is a table over pairs of characters, in thousandths, so
that sums are exact whatever their order.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns; the number is the least length of the group.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
}
KINDS = [*BASE, "markov"]
#: Runs that the models judge, and the least ratio for a span: natural log, in thousandths, and a character's mean.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
LEAST_RATIO = 14_000
LEAST_MEAN = 700
LEAST_CHARS = 16

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
#: Rows of the built-in labelled sample, of each label.
SAMPLE_ROWS = 4000

# Words of ordinary identifiers.
IDENTIFIER_WORDS = (
    "account action address agent alert amount answer append archive array assign author balance batch before begin branch bridge buffer button "
    "cache call catalog change channel check class client close cluster code column commit config context control copy count current data date debug default "
    "delete detail device direct display document domain download driver element empty enable encode engine entry error event export field file filter find "
    "folder format frame function gateway general global group handler header history image import index input insert instance invoice item journal jump kernel "
    "keyword label language layer layout length level library limit line link list location logger lookup machine manager market match member memory message "
    "method metric model monitor network node number object offset option order output owner package page parent path payment platform query queue quota reader "
    "record region request result route sample schema search server session status storage table target task test thread token type unit update upload user "
    "value vector version video view volume warning watch weight widget window worker write year yield zone zoom"
).split()


def labelled_samples(spark: SparkSession, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``token`` and ``random``: digests in four writings; joined words in five and numbers; made by rule from a counter."""
    ids = spark.range(rows)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id")), 256)
    raw = F.base64(F.unhex(digest))
    random = F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 40)).when(F.col("id") % 4 == 1, F.substring(raw, 1, 40))
    random = random.when(F.col("id") % 4 == 2, F.upper(F.substring(F.regexp_replace(raw, "[+/=]", ""), 1, 32))).otherwise(F.substring(F.regexp_replace(raw, "[+/=]", ""), 1, 36))
    words = F.expr("split('" + " ".join(IDENTIFIER_WORDS) + "', ' ')")
    pick = [F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(IDENTIFIER_WORDS))).cast("int")) for k in range(4)]
    plain = F.when(F.col("id") % 6 == 0, F.concat_ws("_", *pick)).when(F.col("id") % 6 == 1, F.concat(pick[0], *(F.initcap(x) for x in pick[1:])))
    plain = plain.when(F.col("id") % 6 == 2, F.concat_ws("-", *pick)).when(F.col("id") % 6 == 3, F.upper(F.concat_ws("_", *pick[:3])))
    plain = plain.when(F.col("id") % 6 == 4, F.abs(F.xxhash64("id") % 10**18).cast("string")).otherwise(F.concat(*pick[:2], F.lit("/"), *pick[2:]))
    return ids.select(random.alias("token"), F.lit(True).alias("random")).unionByName(ids.select(plain.alias("token"), F.lit(False).alias("random")))


def fit(samples: DataFrame, smoothing: float = 0.5) -> list[int]:
    """The ratio's table, from a labelled sample: entry ``a * n + b`` is for character b after a, in thousandths.

    The counts that come to the driver are at most two for each pair of the alphabet. Other characters are
    not counted; without samples every entry is 0.
    """
    n = len(ALPHABET)
    place = F.instr(F.lit(ALPHABET), F.col("x"))
    spots = F.sequence(F.lit(1), F.greatest(F.length("token") - 1, F.lit(1)))
    pairs = samples.where(F.length("token") > 1).select("random", F.explode(F.transform(spots, lambda i: F.substr(F.col("token"), i, F.lit(2)))).alias("pair"))
    counts = pairs.groupBy("random", "pair").count()
    table = {(bool(r["random"]), r["pair"][0], r["pair"][1]): r["count"] for r in counts.collect() if set(r["pair"]) <= set(ALPHABET)}
    out = []
    for a in ALPHABET:
        total = {k: sum(table.get((k, a, b), 0) for b in ALPHABET) for k in (True, False)}
        for b in ALPHABET:
            p, q = ((table.get((k, a, b), 0) + smoothing) / (total[k] + smoothing * n) for k in (True, False))
            out.append(round(1000 * math.log(p / q)))
    return out


def ratio(token: Column, table: list[int]) -> Column:
    """STRUCT<sum, best, n> over the token's pairs of characters: the table's sum, and the largest sum of a stretch and its characters.

    Characters outside the alphabet add nothing. The best stretch finds a key that ordinary words are joined to.
    """
    n = len(ALPHABET)
    values = F.expr("cast(split('" + ",".join(map(str, table)) + "', ',') as array<int>)")
    codes = [0] * 128
    for i, c in enumerate(ALPHABET):
        codes[ord(c)] = i + 1
    places = F.expr("cast(split('" + ",".join(map(str, codes)) + "', ',') as array<int>)")
    at = F.transform(F.split(token, ""), lambda c: F.coalesce(F.get(places, F.ascii(c)), F.lit(0)))
    names = ("last", "sum", "run", "chars", "best", "n")

    def add(acc: Column, code: Column) -> Column:
        step = F.when((acc["last"] > 0) & (code > 0), F.coalesce(F.get(values, (acc["last"] - 1) * n + code - 1), F.lit(0))).otherwise(0)
        run, chars = F.when(acc["run"] > 0, acc["run"] + step).otherwise(step), F.when(acc["run"] > 0, acc["chars"] + 1).otherwise(2)
        more = run > acc["best"]
        new = (code, acc["sum"] + step, run, chars, F.when(more, run).otherwise(acc["best"]), F.when(more, chars).otherwise(acc["n"]))
        return F.struct(*(c.alias(k) for c, k in zip(new, names, strict=True)))

    return F.aggregate(at, F.struct(*(F.lit(0).alias(k) for k in names)), add, lambda acc: F.struct(acc["sum"].alias("sum"), acc["best"].alias("best"), acc["n"].alias("n")))


def place_matches(text: Column, pattern: str, group: int, matches: Column, least: int, kind: int) -> Column:
    """Array of (start, kind, end, value) of the matches whose group has ``least`` characters, in code points."""
    one = "struct<start:int,kind:int,end:int,value:string>"
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    parts = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("before"), matches.alias("whole"), values.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["whole"])
        new = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["found"], new)).otherwise(acc["found"]).alias("found"))

    none = F.array().cast(f"array<{one}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))
    return F.when(F.size(matches) > 0, F.aggregate(parts, start, step, lambda acc: acc["found"])).otherwise(none)


def written(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, table: list[int], least_ratio: int = LEAST_RATIO, least_mean: int = LEAST_MEAN) -> DataFrame:
    """``docs`` with ``found``: a sorted array of (start, kind, end, value), kind an index of ``KINDS``.

    Null and empty texts have an empty array. Ends are exclusive, places count code points, and a place can
    be in several kinds' spans. Columns of ``docs`` named as one of this function's are replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    patterns = {**BASE, "markov": (CANDIDATE, 0, 16)}
    out = docs.withColumns({f"_m_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, (p, _, _) in patterns.items()})
    out = out.withColumns({f"_s_{k}": place_matches(text, p, g, F.col(f"_m_{k}"), least, i) for i, (k, (p, g, least)) in enumerate(patterns.items())})

    def judged(s: Column) -> Column:
        r = s["ratio"]
        whole = (r["sum"] >= least_ratio) & (r["sum"] >= least_mean * F.length(s["value"]))
        return whole | ((r["best"] >= least_ratio) & (r["n"] >= LEAST_CHARS) & (r["best"] >= least_mean * r["n"]))

    # The ratio is a field of its own, so that each run is read once.
    rated = F.transform("_s_markov", lambda s: F.struct(s.alias("s"), ratio(s["value"], table).alias("ratio"), s["value"].alias("value")))
    out = out.withColumn("_s_markov", F.transform(F.filter(rated, judged), lambda x: x["s"]))
    found = F.array_sort(reduce(lambda a, b: F.concat(a, b), [F.col(f"_s_{k}") for k in patterns]))
    return out.withColumn("found", found).drop(*(f"_{x}_{k}" for x in "ms" for k in patterns))


def redact(text: Column, found: Column) -> Column:
    """The text with ``[SECRET]`` in place of the union of its spans."""
    joined = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[SECRET]"))).otherwise(F.lit(""))).alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)),
    )
    return F.when(F.size(found) > 0, joined).otherwise(text)


def digest(docs: DataFrame, table: list[int]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_markov, a row per document.

    Null and empty texts have no spans. A row for each row, repeated ones and null ids too; an empty table gives
    no rows; other columns are ignored.
    """
    rows = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), table)
    count = lambda i: F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return rows.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), count(len(BASE)).alias("n_markov"))
