"""Corpus operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidemark.llm import common, decontaminate, line_dedup, minhash, mixing, quality_crf, quality_rules, queries, token_counts, toxicity, url_filter, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
LONG = "word " * 30_000 + "\n" + "x" * 50_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, long and repeated texts, under columns that operators use inside."""
    rows = [
        (1, "one two three four five six seven eight nine ten. " * 8, "en", "a", 400), (1, "one two three four five six seven eight nine ten. " * 8, "en", "a", 400),
        (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t ", "en", None, 4), (None, "a text without an id", "en", "c", 20),
        (5, LONG, "en", "a", len(LONG)), (6, "Ünï ### $$$ <|endoftext|> 文字 \x1c é", "de", "b", 20), (7, "short\nshort\nshort", "fr", "c", 17),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"n": F.lit(1), "key": F.lit("k"), "rep": F.lit(2), "bucket": F.lit(3), "component": F.lit(4), "size": F.lit(9), "id": F.lit(0), "score": F.lit(0.5), "label": F.lit(1)})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (7, 0, 1), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_rules(text):
    words = WORDS(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if WORDS(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(spark, docs, odd):
    extra = spark.createDataFrame([(k, " ".join(random.Random(k).choices("abc", k=n))) for k, n in enumerate((0, 1, 2, 3, 4, 60, 400, 3000))], "doc_id long, text string")
    for frame in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), extra):
        got = quality_rules.quality_rules(frame)
        for r in got.collect():
            want = brute_rules(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r["kept"] and r["base_failed"])


def test_rule_order_keeps_verdicts(docs, odd):
    rules = quality_rules.default_rules()
    one = quality_rules.cascade(quality_rules.base_counts(docs), rules).where("rejected_by is null").select("doc_id")
    two = quality_rules.cascade(quality_rules.base_counts(docs), rules[::-1]).where("rejected_by is null").select("doc_id")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    out = quality_rules.quality_rules(odd)
    assert out.count() == 9 and set(odd.columns) <= set(out.columns)
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


def test_rules_are_ordered_by_rejections_per_cost(spark):
    c = F.col
    rules = [
        quality_rules.Rule("dear", c("n_words") < 60, F.lit(1000)), quality_rules.Rule("cheap", c("n_words") < 55, F.lit(9)),
        quality_rules.Rule("never", c("n_words") < 0, F.lit(0)), quality_rules.Rule("often", c("n_words") < 60, F.lit(4)),
    ]
    frame = spark.createDataFrame([(k, "w " * (50 + k % 20)) for k in range(200)], "doc_id long, text string")
    # 50 rows in 1000 + 1, 25 in 9 + 1 (that is, half of 5 in 10), none, 50 in 4 + 1 of each 100
    assert [r.name for r in quality_rules.order_rules(frame, rules)] == ["often", "cheap", "dear", "never"]
    assert quality_rules.order_rules(frame.limit(0), rules) == rules and quality_rules.order_rules(frame, []) == []
    one, two = (sorted(map(repr, quality_rules.quality_rules(frame).select("doc_id", "rejected_by").collect())) for _ in range(2))
    assert one == two


def test_rules_are_native(docs):
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, agree):
    agree(queries.QUERIES[name], queries.SQL[name])


def test_lines_on_odd_input(odd):
    out = line_dedup.line_dedup(odd, min_sites=2)
    assert out.columns == [*odd.columns, "_ld_lines", "_ld_removed"]
    rows = out.collect()
    assert len(rows) == 9 and {r["doc_id"]: r["text"] for r in rows}[2] is None
    assert line_dedup.line_dedup(odd.limit(0)).count() == 0


def test_lines_near_threshold_are_exact(spark):
    rows = [(s * 100 + k, f"body {s} {k} of its own words here\nshared {k}", f"s{s}") for s in range(12) for k in range(13) if s < k]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in line_dedup.line_dedup(frame, min_sites=6, lg_k=4, band=0.9).collect():
        assert r["_ld_removed"] == int(r["doc_id"] % 100 >= 6)


def test_whole_copies_can_be_spared(spark):
    frame = spark.createDataFrame([(k, "a line of words\nanother line of words", f"s{k}") for k in range(9)], "doc_id long, text string, source string")
    assert line_dedup.line_dedup(frame, spare_copies=True).where("_ld_removed > 0").count() == 0
    assert line_dedup.line_dedup(frame).where("_ld_removed = 2 and text = ''").count() == 9


def test_only_copies_are_spared(spark):
    shared = ["licence line one of many words here", "footer line of the usual sort", "another notice that all carry"]
    body = [" ".join(f"c{i}x{j}" for j in range(12)) for i in range(10)]
    rows = [(k, f"own{k} " * 30 + "\n" + "\n".join(shared), f"s{k}") for k in range(6)]
    rows += [(10, "\n".join(shared[:2]), "s1"), (11, shared[2] + "\nown few words", "s2"), (12, shared[2] + "\n" + shared[0] + " ", "s3")]
    rows += [(20 + k, "\n".join([*body, f"tail{k}"]), f"s{k}") for k in range(7)]
    frame = spark.createDataFrame([*rows, (30, "\n".join(shared[:1]), "s4"), (31, "\n".join(shared[:1]), "s5")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["_ld_removed"]) for r in line_dedup.line_dedup(frame, spare_copies=True).collect()}
    assert (got[10], got[11], got[12]) == (("", 2), ("own few words", 1), ("", 2))
    assert all(got[k][1] == 3 for k in range(6))
    assert all(got[k] == (t, 0) for k, t, _ in rows if k >= 20) and got[30][1] == got[31][1] == 0


def test_boilerplate_goes_whatever_its_share(spark):
    rows = [(k, f"own line {k}\nfooter one of words\nfooter two of words\nfooter three of words\nfooter four of words", f"s{k}") for k in range(20)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r["text"], r["_ld_removed"], r["_ld_lines"]) for r in got} == {(f"own line {k}", 4, 5) for k in range(20)}


def test_lines_by_shuffle_equal_lines_by_broadcast(docs, odd):
    for frame, sites in ((docs, 6), (odd, 1)):
        one = line_dedup.line_dedup(frame, min_sites=sites)
        two = line_dedup.line_dedup(frame, min_sites=sites, broadcast_keys=0)
        assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect())) and one.where("_ld_removed > 0").count()


def test_line_keys_equal_the_engine(spark, docs):
    texts = ["", "a", "line of words", "é" * 40, *[r[0][:700] for r in docs.where("text is not null").select("text").limit(60).collect()]]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *line_dedup._hashes(F.col("t")))
    for t, *keys in frame.collect():
        assert tuple(k & (1 << 64) - 1 for k in keys) == line_dedup.line_keys(t.encode())


def test_lines_of_a_long_text_and_of_one_hot_text(spark):
    lines = "\n".join(f"line {k} of a long text" if k % 3 else "shared footer" for k in range(200_000))
    hot = [(10 + k, "copied text\nshared footer", f"s{k % 9}") for k in range(3000)]
    frame = spark.createDataFrame([(1, lines, "s1"), *hot], "doc_id long, text string, source string")
    for keys in (500_000, 0):
        got = {r["doc_id"]: (r["_ld_lines"], r["_ld_removed"], r["text"]) for r in line_dedup.line_dedup(frame, broadcast_keys=keys).collect()}
        assert got[1][:2] == (200_000, 66_667) and "shared" not in got[1][2]
        assert {v for k, v in got.items() if k >= 10} == {(2, 2, "")}


def test_token_counts_equal_library(docs, odd):
    library = token_counts._load("byte_bpe_50k.json")
    for frame in (docs, odd):
        texts = {(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()}
        want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in texts)
        got = token_counts.token_counts(frame, max_entries=500, cache_bytes=5000)
        assert sorted({(str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got.collect()}) == want
        assert got.count() == frame.count()
        assert got.where("over_limit <> (n_tokens > 1024)").count() == 0
    assert token_counts.token_counts(odd.limit(0)).count() == 0


def test_token_splitting_equals_library_everywhere():
    import regex

    split, unchecked, library = regex.compile(token_counts.PATTERN).findall, regex.compile(token_counts.UNCHECKED).fullmatch, token_counts._load("byte_bpe_50k.json")
    for cp in range(0x10000):
        c = chr(cp)
        if 0xD800 <= cp < 0xE000 or unchecked(c):
            continue
        s = f"a{c}a {c}1{c}. {c}"
        assert [s[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)] == split(s), hex(cp)


def test_token_runs_equal_library(monkeypatch):
    library, draw = token_counts._load("byte_bpe_50k.json"), random.Random(4)
    parts = ["a", "b", " ", "  ", "\n", "\t", " \n", "'s", "'ll", "1", "23", ".", "!!", "é", "文字", " ", "\u3000", "<|endoftext|>", "\U0001f600", "\x1c", "\x85", "\u2028", "ꙮ", "'", " the"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 14))) for _ in range(8000)]
    counts = token_counts.Lengths({}, library, 20_000)
    want = [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.count(texts) == want
    cut = token_counts._slices
    monkeypatch.setattr(token_counts, "_slices", lambda t: cut(t, 5))  # slices of a few characters
    assert token_counts.Lengths({}, library, 20_000).count(texts) == want
    assert len("".join(token_counts._slices("a b " * 50))) == 200


def test_token_counter_is_kept_by_its_process():
    from types import SimpleNamespace

    import psutil

    texts = ["".join(random.Random(k).choices("abcdefgh ", k=3000)) for k in range(40)]
    head, me = SimpleNamespace(value={"a": 1}), psutil.Process()
    first = token_counts.worker_lengths("byte_bpe_50k.json|x", head, "byte_bpe_50k.json", 1_000_000)
    first.count(texts)
    before = me.memory_info().rss
    for _ in range(100):
        again = token_counts.worker_lengths("byte_bpe_50k.json|x", head, "byte_bpe_50k.json", 1_000_000)
        assert again is first
        again.count(texts)
    for k in range(5):  # other calls of the same tokenizer do not load it again
        assert token_counts.worker_lengths(f"byte_bpe_50k.json|y{k}", head, "byte_bpe_50k.json", 1_000_000).tokenizer is first.tokenizer
    assert me.memory_info().rss - before < 50_000_000
    assert all(len(c.young) + len(c.old) <= 1_000_000 // token_counts._ENTRY + 1000 for c in (first.runs, first.pieces))


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_myers_and_pieces_equal_brute_force():
    draw = random.Random(5)
    for _ in range(300):
        p, t = draw.choices("abcd", k=draw.randint(1, 90)), draw.choices("abcd", k=draw.randint(0, 60))
        masks = {}
        for i, w in enumerate(p):
            masks[w] = masks.get(w, 0) | 1 << i
        assert decontaminate.myers(masks, len(p), t) == distance(p, t)
    vocabulary = [f"w{i}" for i in range(12)]
    for _ in range(150):
        items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(1, 30)))) for i in range(3)]
        doc = []
        for _ in range(3):
            doc += draw.choices(vocabulary, k=draw.randint(0, 20))
            w = draw.choice(items)[1].split()
            for _ in range(draw.randint(0, 6)):
                j = draw.randrange(len(w) + 1)
                w[j : j + draw.randint(0, 1)] = draw.choices(["zz", *vocabulary], k=draw.randint(0, 2))
            doc += w
        got = sorted(decontaminate.Matcher(items, 0.2).match(", ".join(doc)))
        assert got == sorted((i, d) for i, t in items for d in [distance(t.split(), doc)] if d <= int(0.2 * len(t.split())))


def test_leaks_equal_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    split = lambda t: re.findall(r"\w+", t.lower())
    items = [(r[0], split(r[1])) for r in bench.collect()]
    some = docs.where("length(text) < 1500")
    want = set()
    for d, t in some.select("doc_id", "text").collect():
        words = split(t)
        have = set(words)
        for i, p in items:
            k = int(0.15 * len(p))
            if sum(w not in have for w in p) <= k and distance(p, words) <= k:
                want.add((d, i, distance(p, words)))
    got = decontaminate.find_leaks(some, bench, block_chars=2000)
    assert {tuple(r) for r in got.collect()} == want and want
    kept = decontaminate.drop_leaks(some, bench, block_chars=2000)
    assert {r[0] for r in some.select("doc_id").collect()} - {r[0] for r in kept.select("doc_id").collect()} == {d for d, *_ in want}


def test_leaks_on_odd_input(spark, odd):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "ONE two, three four five six seven EIGHT nine"), (4, "one two three four five six seven eight nine"), (5, "three four FIVE"), (6, "文字")], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.find_leaks(odd, bench).collect()))
    assert got == [(1, 4, 0)] * 4 + [(1, 5, 0)] * 2 + [(6, 6, 0)]
    assert decontaminate.drop_leaks(odd, bench).count() == 6 and decontaminate.drop_leaks(odd, bench).columns == odd.columns
    assert decontaminate.find_leaks(odd, bench.limit(0)).count() == 0 and decontaminate.find_leaks(odd.limit(0), bench).count() == 0


def test_short_and_unspaced_items_are_searched():
    matcher = decontaminate.Matcher([(1, "words that must all be there"), (2, "统计数据显示人口"), (3, "x" * 3), (4, "  ")], 0.15)
    assert matcher.match("he said: Words, that must all be there!") == [(1, 0)]
    assert matcher.match("words that must not be there") == []
    assert sorted(matcher.match("根据统计数据,显示人口增长 xxx")) == [(2, 0), (3, 0)]
    assert matcher.match("统数据计示显口人") == []


def test_a_long_text_is_searched_whole():
    matcher = decontaminate.Matcher([(1, " ".join(f"q{k}" for k in range(20)))], 0.15)
    filler = " ".join(f"w{k % 977}" for k in range(300_000))
    assert matcher.match(filler + " " + " ".join(f"q{k}" for k in range(20) if k != 7)) == [(1, 1)]


def test_urls(spark):
    rows = [
        (1, "http://X.Example.NET/en/1", "<p>free bets</p>"), (2, "https://a.example.net/EN/1", None), (3, "http://example.com/de/x?y=1", ""), (4, "http://b.org/fr/#a", None), (5, None, None), (6, "no scheme", None),
        (7, "http://casinowin.example.org/en/", "casino win"), (7, "http://casinowin.example.org/en/", "casino win"), (8, "http://notexample.com/de/", None), (None, "http://plain.example.org?x", None), (9, "http://" + "a" * 3000 + ".org/en", None),
    ]
    got = url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)))
    by = {r["page_id"]: r for r in got.collect()}
    assert got.count() == len(rows)
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("x.example.net", "/en/1", "example.net/en/", "allow")
    assert (by[2]["rule"], by[3]["rule"], by[4]["rule"], by[8]["rule"]) == ("net/", "example.com/de/", "org/fr/", None)
    assert (by[5]["host"], by[5]["path"], by[6]["host"]) == ("", "", "") and by[None]["path"] == ""
    assert by[7]["verdict"] == "block"
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_verdicts(rows):
    """Every split tried, every count by hand."""
    from functools import cache

    def parts(url):
        head, sep, tail = (url or "").partition("://")
        m = re.match(r"([^/?#]*)([^?#]*)", tail if sep else "", re.S)
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]

    urls = [(i, *parts(u)) for i, u, _ in rows]
    pieces = {t: [p for p in re.split("[^a-z-]+", t)] for _, h, p in urls for t in (h, p.lower()) if t}
    counts = Counter()
    for _, _, html in rows:
        seen = re.sub(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", (html or "").lower(), flags=re.S)
        counts.update(w for w in re.findall("[a-z]+", seen) if 1 < len(w) <= 20)
    counts.update({r: 20 for r in {r for ps in pieces.values() for p in ps if "-" in p for r in p.split("-") if r and len(r) <= 20}})
    counts.update(dict.fromkeys(url_filter.SEEDS, 1000))
    whole = sum(counts.values())

    def price(w):
        return -math.log((counts[w] if w in counts else 10.0 ** (1 - len(w))) / whole)

    @cache
    def split(run):
        if not run:
            return 0.0, ()
        return min(((price(run[:k]) + split(run[k:])[0], (run[:k], *split(run[k:])[1])) for k in range(1, min(20, len(run)) + 1)), key=lambda x: (round(x[0], 9), x[1]))

    words = {t: [w for p in ps for r in p.split("-") for w in split(r)[1]] for t, ps in pieces.items()}
    table, size = {True: Counter(), False: Counter()}, Counter()
    for _, h, p in urls:
        mine = words.get(h, []) + words.get(p.lower(), [])
        blocked = any(w in url_filter.SEEDS for w in mine)
        table[blocked].update(mine)
        size[blocked] += 1
    kinds = len(set(table[True]) | set(table[False]))
    n = {k: sum(t.values()) for k, t in table.items()}
    out = []
    for i, h, p in urls:
        rule = max((r for r in url_filter.RULES if (h == r.partition("/")[0] or h.endswith("." + r.partition("/")[0])) and p.startswith("/" + r.partition("/")[2])), key=len, default=None)
        odds = math.log((size[True] + 1) / (size[False] + 1))
        for w in words.get(h, []) + words.get(p.lower(), []):
            odds += math.log((table[True][w] + 1) / (n[True] + kinds)) - math.log((table[False][w] + 1) / (n[False] + kinds))
        out.append((i, h, p, rule, url_filter.RULES[rule] if rule else "block" if odds > 1e-7 else "allow"))
    return out


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_urls_equal_brute_force(spark, broadcast_rows):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()] + [(900 + k, u, "<p>big win free pills</p>") for k, u in enumerate(("http://bigwinpills.example.org/a-b-c/freepills", "http://big-win.example.org/x", "http://plainshop.example.org/", None, "HTTP://EXAMPLE.org/FR/x"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    # so many buckets that no two words meet in one
    got = url_filter.url_verdicts(frame, buckets=1 << 31, broadcast_rows=broadcast_rows).select("page_id", "host", "path", "rule", "verdict")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_verdicts(rows)))


def test_model_tells_concatenated_names_apart(spark):
    """Names made of words that go with seed words are blocked, seed word or not; others are left alone."""
    draw = random.Random(6)
    bad, good = ["jackpot", "bonus", "slots", "winner", "spins"], ["garden", "school", "recipe", "travel", "museum"]
    rows, truth = [], {}
    for k in range(600):
        words = draw.choices(bad if k % 3 == 0 else good, k=2)
        if k % 3 == 0 and k % 2:
            words.append(draw.choice(["casino", "poker", "betting"]))
        truth[k] = "block" if k % 3 == 0 else "allow"
        rows.append((k, f"https://{''.join(words)}{k}.example.com/{draw.choice(bad if k % 3 == 0 else good)}", f"<p>{' '.join(bad + good)}</p>"))
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert np.mean([got[k] == truth[k] for k in truth]) > 0.97


def test_visible_text_is_linear_and_right():
    import time

    old = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S)
    draw = random.Random(1)
    for _ in range(500):
        html = "".join(draw.choices(["<script>", "</script >", "</script x", "<style a>", "</style>", "<p>", "a", "B c", "<", ">", "</p"], k=draw.randint(0, 12)))
        assert url_filter.visible(html).split() == old.sub(" ", html.lower()).split(), html
    for bad in ("<script>x", "<", "<style></style ", "<p"):
        began = time.perf_counter()
        url_filter.visible(bad * 100_000)
        assert time.perf_counter() - began < 5


def test_long_urls(spark):
    rows = [(1, "http://" + "casino" * 4000 + ".org/" + "a-b" * 3000, None), (2, "http://x.org/" + "/q" * 50_000, "")]
    got = {r["page_id"]: r["verdict"] for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "allow"}


def test_segmentation():
    known = {"casino": 50, "win": 20, "the": 900, "re": 5, "there": 300}
    assert url_filter.best_split("casinowin", known, 2000.0, 20) == ["casino", "win"]
    assert url_filter.best_split("there", known, 2000.0, 20) == ["there"]
    assert url_filter.best_split("", known, 2000.0, 20) == []


def brute_components(rows, percent=85):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    holders = defaultdict(list)
    seen = Counter(g for s in sets.values() for g in s)
    for d, s in sets.items():
        for g in sorted(s, key=lambda g: (seen[g], g))[: len(s) - math.ceil(percent / 100 * len(s)) + 1]:
            holders[g].append(d)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for group in holders.values():
        for a, b in combinations(group, 2):
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_copies():
    """A base, copies that each link with the base but hardly with each other, chains, and copies of copies."""
    draw = random.Random(9)
    base = [f"b{draw.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(60):
        w = list(base)
        for j in draw.sample(range(200), 2 + k % 4):
            w[j] = f"n{k}x{j}"
        rows.append((100 + k, " ".join(w)))
    rows += [(20 + k, rows[k][1].upper()) for k in range(10)]
    chain = [f"c{i}" for i in range(150)]
    for k in range(8):
        rows.append((300 + k, " ".join(chain[2 * k :] + [f"t{k}{i}" for i in range(2 * k)])))
    rows += [(400 + k, f"w{k} few words") for k in range(5)] + [(410, "W1 few words"), (411, ""), (412, None), (413, "one")]
    return rows


def test_near_duplicates_equal_brute_force(spark, docs):
    for rows in (near_copies(), [tuple(r) for r in docs.select("doc_id", "text").collect()]):
        frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(frame, block_hashes=4000, block_rows=9).collect()}
        assert got == brute_components(rows)


def test_near_duplicates_on_odd_input(odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == 9 and all(r["component_id"] == r["doc_id"] for r in got)
    assert [r["kept"] for r in got if r["doc_id"] is None] == [False]
    kept = minhash.keep_one(odd)
    assert kept.count() == 8 and kept.columns == odd.columns  # of the two rows of document 1 one stays
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_an_id_on_several_texts_links_their_groups(spark):
    draw = random.Random(3)
    a, b = ([f"{p}{draw.randrange(10**6)}" for _ in range(41)] for p in "ab")
    edit = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, edit(a)), (3, edit(b)), (4, " ".join(b)), (5, "unlike all others here")]
    rows += [(7, "unlike all others here"), (7, "a text of its own"), (8, "A text of its own")]
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (7, 5), (8, 5)}


def test_hot_keys_are_dealt_out(spark):
    left = spark.range(5000).select((F.when(F.col("id") < 4000, 1).when(F.col("id") < 4500, None).otherwise(F.col("id"))).alias("k"), "id")
    right = spark.createDataFrame([(1, "x"), (4600, "y")], "k long, v string")
    hot = common.hot_keys(left, ["k"], least=100)
    out = hot.join(left, right, ["id"], "left")
    assert out.count() == 5000 and out.where("v = 'x'").count() == 4000 and out.where("v = 'y'").count() == 1
    assert {r["_salts"] for r in hot.hot.collect()} >= {40} and hot.join(left, right, ["id"]).count() == 4001


def test_cells_of_many_short_texts_stay_small():
    import resource

    draw = np.random.default_rng(8)
    base = draw.integers(0, 2**64, 12, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[draw.permutation(12)[:8]], draw.integers(0, 2**64, 3, dtype=np.uint64)])) for _ in range(2000)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    got = minhash._spanning(np.arange(2000), np.arange(2000), sets, 70)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
    some = [(i, j) for i, j in combinations(range(2000), 2) if i < 60 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j]))]
    parent = list(range(2000))

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for i, j in got:
        parent[root(i)] = root(j)
    assert all(root(i) == root(j) for i, j in some) and len(got) == 2000 - len({root(i) for i in range(2000)})


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(map(tuple, minhash.components(links).collect()))
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_few_links_take_no_rounds(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(900), draw.randrange(900)) for _ in range(700)] * 2 + [(k, k + 1) for k in range(2000, 2200)] + [(2**62, -(2**62))]
    links, stage = spark.createDataFrame(rows, "a long, b long"), spark.sparkContext._jsc.sc().dagScheduler().nextStageId
    before = stage()
    got = dict(map(tuple, minhash.components(links).collect()))
    assert stage() - before < 8 and got[2200] == 2000 and got[2**62] == -(2**62)
    assert dict(map(tuple, minhash.components(links, few=10).collect())) == got


def test_densified_signatures_estimate_similarity():
    draw, signer, rng = random.Random(2), minhash.Signer(32, 6), np.random.default_rng(1)
    for n in (3, 40, 2000):
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = np.concatenate([a[: n - n // 3], rng.integers(0, 2**64, n // 3, dtype=np.uint64)])
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = (signer.signature(np.unique(a)) == signer.signature(np.unique(b))).mean()
        assert abs(got - want) < 0.2, (n, draw.random())


def test_warc_round_trip(spark):
    big, marker = "é" * 40_000, "x\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n" * 60
    rows = [(1, "http://a/", "same " * 300), (2, None, "same " * 300), (5, "u", "same " * 300), (5, "u", "same " * 300), (3, "http://b/\r\nX: y", big), (3, "b", big), (4, "c", marker), (6, "d", None), (7, "e", ""), (None, "f", "same " * 300), (8, "g", "short"), (9, "h", "short")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit(0))
    got = warc.round_trip(frame, segment_bytes=3000, chunk_bytes=500)
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    want = con.sql(warc.ROUND_TRIP_SQL).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, want))
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_warc_reports_damage(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"abcdef" * 10
    def record(kind, rid, body, *more):
        return "\r\n".join(["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *more, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"

    data = record("response", "<a>", block[:20], "WARC-Segment-Number: 1") + record("continuation", "<a2>", block[20:50], "WARC-Segment-Origin-ID: <a>", "WARC-Segment-Number: 2")
    data += record("continuation", "<a3>", block[50:], "WARC-Segment-Origin-ID: <a>", "WARC-Segment-Number: 3", f"WARC-Segment-Total-Length: {len(block)}")
    data += record("response", "<b>", block[:20], "WARC-Segment-Number: 1") + record("continuation", "<b3>", block[50:], "WARC-Segment-Origin-ID: <b>", "WARC-Segment-Number: 3", f"WARC-Segment-Total-Length: {len(block)}")
    (tmp_path / "x.warc").write_bytes(data)
    got = {r["origin"]: (r["payload"], r["intact"]) for r in warc.read_warc(spark, f"file://{tmp_path}").collect()}
    assert bytes(got["<a>"][0]) == b"abcdef" * 10 and got["<a>"][1] and got["<b>"] == (None, False)


def test_warc_files_are_members_and_bounded(spark, tmp_path):
    import gzip
    import zlib

    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("é<p>"), 900)).alias("html"))
    warc.write_warc(pages.coalesce(1), f"file://{tmp_path}/w", segment_bytes=1000, file_bytes=60_000)
    files = sorted(f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-"))
    assert len(files) > 5
    for f in files:
        data, kinds = f.read_bytes(), []
        assert len(gzip.decompress(data)) < 80_000
        while data:
            part = zlib.decompressobj(31)
            record, data = part.decompress(data), part.unused_data
            assert part.eof and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
            kinds.append(re.search(rb"WARC-Type: (\w+)", record)[1])
        assert kinds[0] == b"warcinfo" and kinds.count(b"warcinfo") == 1
    assert warc.read_warc(spark, f"file://{tmp_path}/w").where("intact").count() == 300


def test_warc_of_a_large_page(spark):
    frame = spark.createDataFrame([(1, "u", "x" * 20_000_000), (2, "v", "y")], "page_id long, url string, html string")
    got = {r["page_id"]: r["payload_bytes"] for r in warc.round_trip(frame).collect()}
    assert got == {1: 20_000_000, 2: 1}


def test_chunked_framing():
    for payload in (b"", b"a", "é€".encode() * 1000, bytes(65 for _ in range(5000))):
        assert warc.unchunked(warc.chunked(payload, 7)) == payload


def test_mix(spark, docs, odd):
    for frame in (docs, odd):
        sizes = Counter()
        rows = frame.select("source", "text").collect()
        for r in rows:
            sizes[r["source"]] += len(WORDS(r["text"] or ""))
        order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
        weight, total, cap = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), {}
        while True:
            rest = [s for s in order if s not in cap]
            unit = (total - sum(cap.values())) / max(1, sum(weight[s] for s in rest))
            over = [s for s in rest if unit * weight[s] > 2 * sizes[s] + 1e-9]
            if not over:
                break
            cap |= {s: 2 * sizes[s] for s in over}
        want = {s: cap.get(s, unit * weight[s]) for s in order}
        got = mixing.mix_sources(frame, block_rows=7).collect()
        again = mixing.mix_sources(frame.repartition(3), block_rows=7).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
        assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(frame, block_rows=7, broadcast_sources=0).collect()))
        taken, most = Counter(), Counter()
        for r in got:
            most[r["source"]] = max(most[r["source"]], r["size"])
            assert r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        if frame is docs:
            for s in order:
                assert abs(taken[s] - want[s]) <= most[s]
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def test_mix_deals_equal_rows_over_blocks(spark):
    frame = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a few words").alias("text"), F.lit("s").alias("source"))
    frame = frame.union(spark.createDataFrame([(1, "one two", "t"), (2, "three", "t")], "doc_id long, text string, source string"))
    got = mixing.mix_sources(frame, block_rows=500)
    assert got.count() == 30_002
    by = {r["source"]: r for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert abs(by["s"]["taken"] - by["s"]["target"]) <= 3


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    for _ in range(50):
        p, z = rng.uniform(0, 1, 200), rng.integers(1, 40, 200)
        q = mixing.flight(p, z, rng)
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert q.sum() == pytest.approx(p.sum(), abs=1e-5) and (q * z).sum() == pytest.approx((p * z).sum(), abs=1e-3)
    hits = np.mean([mixing.flight(np.array([0.2, 0.7, 0.5, 0.6]), np.array([3, 3, 3, 3]), np.random.default_rng(k)) for k in range(3000)], axis=0)
    assert hits == pytest.approx([0.2, 0.7, 0.5, 0.6], abs=0.04)


def test_chain_marginals_equal_enumeration():
    rng = np.random.default_rng(6)
    score, trans = rng.normal(size=9), rng.normal(size=(2, 2))
    start, count = np.array([0, 1, 5]), np.array([1, 4, 4])
    good, pairs, norm = quality_crf.marginals(score, start, count, trans)
    want, expected = np.zeros(9), np.zeros((2, 2))
    for k, (s, n) in enumerate(zip(start, count, strict=True)):
        weights = {}
        for bits in range(1 << n):
            y = [bits >> i & 1 for i in range(n)]
            weights[tuple(y)] = math.exp(sum(score[s + i] * v for i, v in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False)))
        z = sum(weights.values())
        assert norm[k] == pytest.approx(math.log(z))
        for y, w in weights.items():
            for i, v in enumerate(y):
                want[s + i] += v * w / z
            for a, b in zip(y, y[1:], strict=False):
                expected[a, b] += w / z
    assert good == pytest.approx(want) and pairs == pytest.approx(expected)


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize(("name", "label", "least"), [("op10_quality_crf", "quality", 0.9), ("op9_toxicity", "toxic", 0.75)])
def test_classifiers_on_held_out_rows(spark, name, label, least):
    sf = SF.replace("0.001", "0.01")
    got = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert auc([(r["score"], r[label]) for r in got.collect()]) > least


def test_classifiers_on_odd_input(spark, odd, labels):
    for module, train in ((quality_crf, quality_crf.train), (toxicity, toxicity.train)):
        score = quality_crf.score_quality if module is quality_crf else toxicity.score_toxicity
        for known in (labels, labels.limit(0)):
            model = train(odd, known)
            rows = score(odd, model).collect()
            assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
            assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
        assert score(odd.limit(0), model).count() == 0
    assert quality_crf.keep_good(odd, quality_crf.train(odd, labels)).columns == odd.columns


def model_of_any(text):
    return model_of(text.lower().encode("latin-1", "replace").decode("latin-1"))


def model_of(text):
    codes = toxicity.CODES[np.frombuffer(f"  {text} ".encode("latin-1"), np.uint8)]
    counts = np.zeros(64**3)
    before = np.where(codes[1:-1] == 0, 0, codes[:-2])
    inside = (codes[1:-1] > 0) | (codes[2:] > 0)
    np.add.at(counts, ((before * 64 + codes[1:-1]) * 64 + codes[2:])[inside], 1)
    return counts


TALK = model_of("you stupid idiot and moron loser are worthless scum they said in the street with trash " * 50)


def test_deobfuscation():
    decoder = toxicity.Decoder(TALK)
    for noisy, plain in (("1d10t", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("looooser", "loser"), ("w0rthless", "worthless"), ("plain", "plain"), ("mоrоn", "moron"), ("sc\u200bum", "scum"), ("ｍｏｒｏｎ", "moron")):
        assert decoder.words(noisy) == [plain]
    for text, found in (("so s t u p i d and s.c.u.m", ["stupid", "scum"]), ("l , o , s , e , r", ["loser"]), ("m  o  r  o  n", ["moron"]), ("a b c", [])):
        assert [decoder.decode(m[0]) for m in toxicity._spelled.finditer(text)] == found


def test_long_spellings_are_decoded():
    decoder = toxicity.Decoder(TALK)
    said = " ".join("youstupididiotandmoronloserareworthlessscumtheysaid")
    assert len(said) > 100 and [m[0] for m in toxicity._spelled.finditer(said)] == [said]
    assert {"stupid", "idiot", "moron"} <= set(decoder.decode(said).split()) or "stupididiot" in decoder.decode(said)
    assert decoder.words("l" + "o" * 200 + "ser") == ["loser"]
    scorer = toxicity.Scorer(decoder, {"=loser": 2.0})
    assert scorer.total("what a l" + "o" * 200 + "ser") == 2.0 and scorer.total("L0ser, loser! loser") == pytest.approx(2 * (1 + math.log(3)))


def test_scores_equal_a_plain_count(spark, docs):
    """Trigrams counted text by text, and totals over all restored words."""
    texts = [r[0] for r in docs.select("text").collect()]
    want = np.zeros(64**3)
    for t in texts:
        if t:
            want += model_of_any(t)
    got = toxicity.trigrams(docs.repartition(3))
    assert (got == want).all()
    decoder, weights = toxicity.Decoder(got), {"=the": 0.5, "stup": 0.3, "=un": -0.2, "comp": 0.1, "compa": 0.4}
    scorer = toxicity.Scorer(decoder, weights, limit=50)
    for t in texts[:60] + [None, "", "STUP1D stupid, the thé The!! l o s e r"]:
        plain = toxicity.restored(t, decoder.words, lambda x: decoder.decode(x).split())
        total = sum(toxicity.weight(n) * sum(weights.get(f, 0.0) for f in toxicity.features(w)) for w, n in plain.items())
        assert scorer.total(t) == pytest.approx(total)


def test_viterbi_equals_enumeration():
    from itertools import product

    draw, decoder, beamed = random.Random(7), toxicity.Decoder(TALK, beam=None), toxicity.Decoder(TALK)
    for _ in range(300):
        text = "".join(draw.choices("stupidmorn10$3 .о", k=draw.randint(1, 6)))
        least = math.inf
        for path in product(*(decoder.readings(text, i) for i in range(len(text)))):
            a = b = 0
            total = 0.0
            for letter, channel in path:
                total += channel
                if letter:
                    k = decoder.code(letter) if letter != " " else 0
                    total += decoder.cost[a][b][k]
                    a, b = (b, k) if k else (0, 0)
            least = min(least, total + decoder.cost[a][b][0])
        assert decoder.best(text)[0] == pytest.approx(least) and beamed.best(text)[0] == pytest.approx(least)


def test_a_labelled_id_on_many_rows_is_learned_once(spark):
    docs = spark.range(60_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("some words of a text").alias("text"))
    rows = quality_crf.learning_rows(docs, spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, quality int"), "quality", "doc_id", "text", 10)
    assert [tuple(r)[:2] for r in rows.collect()] == [(1, "some words of a text")]


def test_long_documents_are_learned_from_and_scored():
    docs = []
    for k in range(40):
        lines = [b"### $$$ !!! >>>" if k % 2 else b"A plain line of ordinary words, as people write them."] * (4000 if k < 4 else 5)
        x = quality_crf.line_features(lines)
        docs.append((1 - k % 2, x, np.array([len(v) + 1 for v in lines], float)))
    model = quality_crf.fit(docs, steps=40)
    long_bad, long_good = "### $$$ !!! >>>\n" * 30_000, "A plain line of ordinary words, as people write them.\n" * 30_000
    got = quality_crf.score_texts([long_bad, long_good, None], model)
    assert got[0] < 0.3 < got[1]
    lines = long_good.encode().split(b"\n")[:700] + [b"$$$ ###"] * 20
    whole = quality_crf.with_neighbours(quality_crf.line_features(lines), np.array([0]), np.array([719])) @ model["weights"]
    assert quality_crf.emissions(lines, model["weights"], 33) == pytest.approx(whole)
