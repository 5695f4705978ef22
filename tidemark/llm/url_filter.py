"""URL filter: explicit rules, then segmented words and naive Bayes.

A rule ``host/path-prefix`` fits its host and all subdomains if the path starts with the rule's; the longest rule decides.
Other URLs go to the model.  Runs of letters in host and path are split into words by unigram Viterbi: word counts come
from the visible text of all pages, from hyphenated host parts and from the seed words; an unknown run costs more with each letter.
Multinomial naive Bayes over the words of host and path then decides.  Its training labels are distant: a URL with a
seed word among its words counts as blocked, all others as allowed.

Scale: hosts and paths count by their letters alone, so paths that differ in numbers are one; only distinct runs are segmented; a run's candidate words reach it by an equi-join of its substrings with the
word counts, so the vocabulary is broadcast only while it is small (``broadcast_rows`` words of ``longest`` letters).  Hosts, paths
and runs go through joins as 128-bit handles, so what a checked broadcast sends is bounded in bytes, and beyond the check
hot keys are dealt over tasks.  The Bayes table has ``buckets`` rows at most (words are hashed), a proven bound.

Null urls and urls without ``://`` have an empty host and path, fit no rule and are judged on no words (the prior).
Very long urls and pages take time linear in their length, whatever tags they leave open.  Odds of exactly 0 allow.
Repeated rows are judged alike, one result row each; null ids stay null; null html adds no words; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HotKeys, cut, hot_keys

#: The contract's rules (fixed values): rule -> verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Words of hosts that are to be blocked.
SEEDS = ("ads", "adult", "bet", "bets", "betting", "casino", "gambling", "lottery", "malware", "phishing", "pills", "poker", "porn", "spam", "viagra", "xxx")
_raw = re.compile(r"<(script|style)\b").match
_run = re.compile(r"[a-z]+").findall


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits (of two as long, the first by name), else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r), reverse=True)[::-1]:
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def visible(html: str) -> str:
    """The text outside tags, scripts and styles, in lower case; each position is gone over once."""
    low, out, at = html.lower(), [], 0
    closes: dict[str, tuple[int, int]] = {}  # where the next closing tag begins and ends; -1: none is left

    def close(name: str, start: int) -> tuple[int, int]:
        found = closes.get(name, (0, 0))
        while 0 <= found[0] < start:
            begin = low.find(f"</{name}", max(start, found[1]))
            end = begin + len(name) + 2
            while begin >= 0 and end < len(low) and low[end].isspace():
                end += 1
            if begin >= 0 and low[end : end + 1] != ">":  # not a closing tag: look on behind it
                found = (start - 1, end)
                continue
            found = (begin, end + 1)
        closes[name] = found
        return found

    while True:
        tag = low.find("<", at)
        end = low.find(">", tag) if tag >= 0 else -1
        m = _raw(low, tag) if tag >= 0 else None
        begin, after = close(m[1], m.end()) if m else (-1, -1)
        if begin >= 0:
            end = after - 1
        if end < 0:
            out.append(low[at:])
            return " ".join(out)
        out.append(low[at:tag])
        at = end + 1


def word_counts(pages: DataFrame, html_col: str, runs: DataFrame, longest: int) -> DataFrame:
    """word, n: words of ``longest`` letters at most in the visible text of all pages, hyphenated host parts and seeds."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0):
                html = t.as_py()
                if html:
                    seen.update(w for w in _run(visible(html)) if 1 < len(w) <= longest)
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    text = pages.select(html_col).mapInArrow(words, "word string, n long")
    parts = runs.where(F.col("hyphened") & (F.length("run") <= longest)).select(F.col("run").alias("word"), F.lit(20).cast("long").alias("n"))
    seeds = pages.sparkSession.createDataFrame([(w, 1000) for w in SEEDS], "word string, n long")
    return text.union(parts).union(seeds).groupBy("word").agg(F.sum("n").alias("n"))


def best_split(run: str, known: dict[str, int], total: float, longest: int) -> list[str]:
    """The words of ``run`` of greatest unigram likelihood; an unknown word of k letters has count 10 ** (1 - k)."""
    cost, back = [0.0] + [math.inf] * len(run), [0] * (len(run) + 1)
    whole = math.log(total)
    for end in range(1, len(run) + 1):
        for begin in range(max(0, end - longest), end):
            n = known.get(run[begin:end])
            c = cost[begin] + whole - (math.log(n) if n else (1 - (end - begin)) * math.log(10))
            if c < cost[end]:
                cost[end], back[end] = c, begin
    out, end = [], len(run)
    while end:
        out.append(run[back[end] : end])
        end = back[end]
    return out[::-1]


def _handle(col, name: str) -> list[Column]:
    """128 bits that stand for a text, as two longs."""
    return [F.xxhash64(col).alias(f"{name}1"), F.xxhash64(F.lit("handle"), col).alias(f"{name}2")]


def lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], broadcast_rows: int, how: str = "left") -> DataFrame:
    """``left`` with what ``right`` (cut; one row a key, of bounded width) says of its keys: broadcast if small, else dealt out."""
    if right.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return left.join(F.broadcast(right), keys, how)
    return hot_keys(left, keys).join(left, right, spread, how)


def segment(runs: DataFrame, counts: DataFrame, longest: int, broadcast_rows: int) -> DataFrame:
    """r1, r2, words: each distinct run (r1, r2, run) split by Viterbi over the counts of its own substrings."""
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    starts = runs.select("r1", "r2", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at"))
    ends = starts.select("r1", "r2", F.substring("run", F.col("at"), F.lit(longest)).alias("tail"))
    subs = ends.select("r1", "r2", F.explode(F.transform(F.sequence(F.lit(1), F.length("tail")), lambda k: F.substring("tail", F.lit(1), k))).alias("word"))
    hits = lookup(subs, counts, ["word"], ["r1", "r2"], broadcast_rows, "inner").select("r1", "r2", "word", "n").distinct()
    hits = hits.groupBy("r1", "r2").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [best_split(r.as_py(), {k["word"]: k["n"] for k in known.as_py() or ()}, total, longest) for r, known in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], names=["r1", "r2", "words"])

    joined = runs.select("r1", "r2", "run").join(hits, ["r1", "r2"], "left").select("r1", "r2", "run", "known")
    return joined.mapInArrow(split, "r1 long, r2 long, words array<string>")


def skeleton(col) -> Column:
    """What words can come from: runs of letters and hyphens, one space between. Paths that differ in numbers alone are one text."""
    return F.btrim(F.regexp_replace(col, "[^a-z-]+", " "))


def tokens_of(urls: DataFrame) -> DataFrame:
    """t1, t2 (handle of the text), run, hyphened of every distinct skeleton of a host or path: its runs of letters, long ones as they are."""
    texts = urls.select(F.col("hs").alias("text")).union(urls.select("ps")).where("text <> ''").distinct()
    pieces = texts.select(*_handle(F.col("text"), "t"), F.explode(F.split("text", " ")).alias("piece"))
    return pieces.select("t1", "t2", F.col("piece").contains("-").alias("hyphened"), F.explode(F.split("piece", "-")).alias("run")).where("run <> ''")


def parse(pages: DataFrame, id_col: str, url_col: str, rules: dict[str, str]) -> DataFrame:
    """id, host, path, rule of every row."""
    url = F.col(url_col)
    out = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))


def url_verdicts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: dict[str, str] | None = None,
    longest: int = 20, buckets: int = 1 << 16, prior: float = 1.0, broadcast_rows: int = 100_000,
) -> DataFrame:
    """id, host, path, rule, verdict, block_odds: one row for each row of ``pages``."""
    rules = RULES if rules is None else rules
    parsed = parse(pages, id_col, url_col, rules).withColumns({"hs": skeleton(F.col("host")), "ps": skeleton(F.lower("path"))})
    parsed = cut(parsed, "parsed")
    tokens = tokens_of(parsed).select("t1", "t2", "hyphened", "run", *_handle(F.col("run"), "r"))
    tokens = cut(tokens, "tokens")
    runs = cut(tokens.groupBy("r1", "r2", "run").agg(F.max("hyphened").alias("hyphened"), F.count("*").alias("n")), "runs")
    counts = cut(word_counts(pages, html_col, runs, longest), "words")
    split = cut(segment(runs, counts, longest, broadcast_rows), "split")
    parts = HotKeys(runs.select("r1", "r2", "n"), ["r1", "r2"], tokens.count()).join(tokens.select("t1", "t2", "r1", "r2"), split, ["t1", "t2"])
    words = parts.select("t1", "t2", F.explode("words").alias("word"))
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")
    words = cut(words.select("t1", "t2", bucket.alias("bucket"), F.col("word").isin(*SEEDS).alias("seed")), "text_words")
    # a text's rows: how often it is a host or a path of a blocked or an allowed URL
    seeded = cut(words.where("seed").select("t1", "t2").distinct().withColumn("seeded", F.lit(True)), "seeded")
    urls = parsed.select("id", "host", "path", "rule", *_handle(F.col("hs"), "h"), *_handle(F.col("ps"), "p"))
    marked = lookup(urls, seeded.toDF("h1", "h2", "s1"), ["h1", "h2"], ["id", "p1"], broadcast_rows)
    marked = cut(lookup(marked, seeded.toDF("p1", "p2", "s2"), ["p1", "p2"], ["id", "h1"], broadcast_rows), "marked")
    marked = marked.withColumn("blocked", F.coalesce("s1", "s2", F.lit(False)))
    use = marked.groupBy("h1", "h2", "blocked").count().toDF("t1", "t2", "blocked", "n").union(marked.groupBy("p1", "p2", "blocked").count())
    use = use.groupBy("t1", "t2").agg(F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("blocked"), 0).otherwise(F.col("n"))).alias("good"))
    table = cut(words.join(use, ["t1", "t2"]).groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "bayes")
    n = table.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0)), F.count("*")).first()
    docs = marked.agg(F.count_if("blocked"), F.count_if(~F.col("blocked"))).first()
    odds = F.log((F.col("bad") + prior) / (n[0] + prior * max(1, n[2]))) - F.log((F.col("good") + prior) / (n[1] + prior * max(1, n[2])))
    # in billionths: whole numbers add up alike in any order
    table = table.select("bucket", F.round(odds * 1e9).cast("long").alias("odds"))
    base = round(1e9 * math.log((docs[0] + prior) / (docs[1] + prior)))
    scores = cut(words.join(F.broadcast(table), "bucket").groupBy("t1", "t2").agg(F.sum("odds").alias("odds")), "scores")
    out = marked.select("id", "host", "path", "rule", "h1", "h2", "p1", "p2")
    out = lookup(out, scores.toDF("h1", "h2", "o1"), ["h1", "h2"], ["id", "p1"], broadcast_rows)
    out = lookup(out, scores.toDF("p1", "p2", "o2"), ["p1", "p2"], ["id", "h1"], broadcast_rows)
    out = out.withColumn("block_odds", (F.lit(base) + F.coalesce("o1", F.lit(0)) + F.coalesce("o2", F.lit(0))) / 1e9)
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.col("block_odds") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "block_odds")


#: DuckDB: host, path and rule of table ``pages``.
RULES_SQL = r"""
with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
r(rule, name, prefix) as (values ('net/', 'net', '/'), ('example.net/en/', 'example.net', '/en/'), ('example.com/de/', 'example.com', '/de/'), ('org/fr/', 'org', '/fr/'))
select page_id, host, path, (select arg_max(rule, length(rule)) from r where (p.host = r.name or ends_with(p.host, '.' || r.name)) and starts_with(p.path, r.prefix)) as rule from p
"""
