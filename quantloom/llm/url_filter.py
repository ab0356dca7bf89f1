"""URL filter: rules first, then words in host and path names scored by naive Bayes.

Names such as ``cheappills`` are split by a unigram Viterbi search: word counts come from the pages' own html (each page parsed
once), joined to the substrings of each distinct name, so the model is never sent to the executors whole. Very long names go in
pieces of PIECE letters, and the search streams on from piece to piece. A multinomial naive Bayes is trained on distinct hosts
and the paths seen with them, every token as often as it stands there. The blocked class is given by ``labels`` (host, blocked)
where there are any; else hosts with a strong seed word are its examples, and seeds count as seen in it. Every page without a
rule gets the sum of its host's and path's log odds.

Hot hosts and paths are judged once and joined back without a task for any of them. Defined results: a null url or one without
``://`` has empty host and path, no tokens, and the verdict of the class prior (allow); null html has no words; very long names
and pages are read whole; ties between splits go to the longest last word; repeated pages get equal verdicts; an empty table
gives no rows. Only the id, url and html columns are read, so others may have any name. Names meet by 64-bit hashes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: (verdict, host and path): the host and its subdomains, paths that start so; the longest wins.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))

#: Words that mark the blocked class in training.
SEEDS = """adult ads affiliate banner bet bets betting bingo bitcoin camgirls casino cheap cialis clickbait
crack escort farm free gamble gambling hentai jackpot keygen levitra loan loans lottery malware milf nude payday
phish phishing pharma pill pills poker popup porn porno pron rolex scam sex sexy slots spam torrent track tracker
tracking viagra virus warez win xxx""".split()
#: Of these only the unmistakable ones make a host an example of the blocked class.
STRONG = frozenset("adult ads bet bets betting bingo camgirls casino cialis escort gamble gambling hentai jackpot keygen levitra lottery malware nude payday phish phishing pill pills poker porn porno scam sex sexy slots spam viagra warez xxx".split())

#: Times that each strong seed counts as seen in the blocked class besides the hosts (in its own estimate only).
SEED_COUNT = 20

#: Letters of the longest word that a split may use, and of a piece of a name.
LONGEST, PIECE = 24, 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NAME = r"[a-z\x{80}-\x{10FFFF}]+"
#: The same letters over UTF-8.
WORD = re.compile(rb"[a-z\x80-\xff]+")
HIDDEN = re.compile(rb"(script|style)\b", re.I)
CLOSED = {name: re.compile(rb"</" + name + rb"\s*>", re.I) for name in (b"script", b"style")}
ENTITY = re.compile(rb"&[a-z0-9#]+;", re.I)


def parsed(pages: DataFrame, url_col: str) -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    return pages.withColumn("host", F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(url, pattern, 2))


def by_rules(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tested first
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def names(col: Column) -> Column:
    return F.regexp_extract_all(F.translate(col, UPPER, LOWER), F.lit(f"({NAME})"), 1)


def visible(html: str | None) -> bytes:
    """Text outside tags, scripts and styles, in one pass: an unclosed script or style hides the rest, a lone < is text."""
    raw, at, out = C.text_of(html), 0, []
    while (i := raw.find(b"<", at)) >= 0:
        out.append(raw[at:i])
        if m := HIDDEN.match(raw, i + 1):
            end = CLOSED[m[1].lower()].search(raw, m.end())
            if end is None:
                return ENTITY.sub(b" ", b" ".join(out))
            at = end.end()
            continue
        end = raw.find(b">", i)
        if end < 0:
            at = i
            break
        at = end + 1
    return ENTITY.sub(b" ", b" ".join([*out, raw[at:]]))


def word_counts(pages: DataFrame, html_col: str) -> DataFrame:
    """(word, n) over the visible text of all pages, A-Z in lower case, summed per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for b in C.chunks(batch, 0):
                for t in b.column(0).to_pylist():
                    if t:
                        n.update(WORD.findall(visible(t).lower()))
            words = [w.decode("utf-8", "replace") for w in n]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    return pages.select(html_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Splitter:
    """The likeliest split of a name, fed in pieces. An unknown word of k letters has probability 10 / (total 10^k)."""

    def __init__(self, total: int):
        self.total, self.floor = total, math.log(10) - math.log(total)
        self.best, self.back, self.letters = [0.0], [0], []

    def feed(self, piece: str, n: int, counts: dict[str, int]) -> None:
        """The first n letters of piece are new starts; what follows only completes words. counts: words at these starts."""
        at = len(self.letters)
        self.letters += piece[:n]
        more = at + len(piece) + 1 - len(self.best)
        self.best += [-math.inf] * more
        self.back += [0] * more
        for i in range(n):
            here = self.best[at + i]
            for k in range(1, min(LONGEST, len(piece) - i) + 1):
                found = counts.get(piece[i : i + k])
                p = here + (math.log(found / self.total) if found else self.floor - k * math.log(10))
                if p > self.best[at + i + k]:
                    self.best[at + i + k], self.back[at + i + k] = p, at + i

    def words(self) -> list[str]:
        name, out, j = "".join(self.letters), [], len(self.letters)
        while j:
            out.append(name[self.back[j] : j])
            j = self.back[j]
        return out[::-1]


def viterbi(name: str, counts: dict[str, int], total: int) -> list[str]:
    s = Splitter(total)
    s.feed(name, len(name), counts)
    return s.words()


def pieces_of(name: str) -> Iterator[tuple[int, str, int]]:
    """(number, letters, how many of them are its own starts)."""
    for k, at in enumerate(range(0, len(name), PIECE)):
        yield k, name[at : at + PIECE + LONGEST - 1], min(PIECE, len(name) - at)


def segmented(spark: SparkSession, distinct_names: DataFrame, counts: DataFrame, seeds: list[str]) -> DataFrame:
    """(name_id, words) for each name; counts reach a name by a join on its substrings. counts: a stored table."""
    total = (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) + 1
    weight = max(1, total // 10_000)
    known = counts.unionByName(spark.createDataFrame([(w, weight) for w in seeds], "word string, n bigint")).groupBy("word").agg(F.sum("n").alias("n"))
    src = distinct_names.select("name_id", "name")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, piece, n in pieces_of(name):
                    subs = list({piece[s:e] for s in range(n) for e in range(s + 1, min(len(piece), s + LONGEST) + 1)})
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(subs), pa.int64()), pa.array([k] * len(subs), pa.int64()), pa.array(subs, pa.string())], names=["name_id", "piece", "word"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(pieces_of(name))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(rows), pa.int64()), *(pa.array([r[c] for r in rows], t) for c, t in ((0, pa.int64()), (1, pa.string()), (2, pa.int64())))], names=["name_id", "piece", "letters", "own"])

    # A piece has at most PIECE x LONGEST known words, however long its name is.
    found = src.mapInArrow(cut, "name_id bigint, piece bigint, word string").join(known, "word").groupBy("name_id", "piece").agg(F.collect_list(F.struct("word", "n")).alias("c"))
    rows = src.mapInArrow(spell, "name_id bigint, piece bigint, letters string, own bigint").join(found, ["name_id", "piece"], "left")
    rows = rows.select("name_id", "piece", "letters", "own", F.col("c.word").alias("w"), F.col("c.n").alias("n"))
    dealt = rows.repartition(C.partitions(spark), "name_id").sortWithinPartitions("name_id", "piece")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, s = None, None
        for b in batches:
            ids, words = [], []
            for i, _, letters, own, w, n in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                if i != now:
                    if s is not None:
                        ids.append(now)
                        words.append(s.words())
                    now, s = i, Splitter(total)
                s.feed(letters, own, dict(zip(w or [], n or [], strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["name_id", "words"])
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([s.words()], pa.list_(pa.string()))], names=["name_id", "words"])

    return dealt.mapInArrow(split, "name_id bigint, words array<string>")


def judge(spark: SparkSession, pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, seeds: list[str] = SEEDS, strong: frozenset[str] = STRONG, labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page with host, path, rule and verdict, and the log odds of being blocked.

    labels: (host, blocked), hosts in lower case; a host named more than once is blocked if any row says so. With labels only
    the hosts they name train the model, and no word counts as a seed.
    """
    rule, by_rule = by_rules(rules)
    narrow = parsed(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "url").select("id", "host", "path", rule.alias("rule"), by_rule.alias("said"))
    # Names of a host or path in order, repeats kept; a key is their hash.
    narrow = narrow.withColumn("hn", names(F.col("host"))).withColumn("pn", names(F.col("path")))
    narrow, pages_path = C.stored(spark, narrow.withColumn("hk", F.xxhash64("hn")).withColumn("pk", F.xxhash64("pn")), "url-pages")
    hosts = narrow.groupBy(F.col("hk").alias("key")).agg(F.first("hn").alias("names"), F.count(F.lit(1)).alias("pages")).withColumn("kind", F.lit("h"))
    paths = narrow.groupBy(F.col("pk").alias("key")).agg(F.first("pn").alias("names"), F.count(F.lit(1)).alias("pages")).withColumn("kind", F.lit("p"))
    keys, keys_path = C.stored(spark, hosts.unionByName(paths), "url-names")
    each = keys.select("kind", "key", F.explode("names").alias("name")).withColumn("name_id", F.xxhash64("name"))
    counts, counts_path = C.stored(spark, word_counts(pages, html_col), "url-counts")
    words, words_path = C.stored(spark, segmented(spark, each.groupBy("name_id").agg(F.first("name").alias("name")), counts, seeds), "url-words")
    tokens = each.join(words, "name_id").select("kind", "key", F.explode("words").alias("token")).groupBy("kind", "key", "token").agg(F.count(F.lit(1)).alias("n"))
    tokens, tokens_path = C.stored(spark, tokens, "url-tokens")

    # Training: one example for each distinct host; the words of the distinct paths seen with it belong to it.
    if labels is None:
        hot = tokens.filter("kind = 'h'").groupBy("key").agg(F.max(F.col("token").isin(*strong)).alias("bad"))
        examples = keys.filter("kind = 'h'").select("key").join(hot, "key", "left").select("key", F.coalesce("bad", F.lit(False)).alias("bad"))
    else:
        named = labels.select(names(F.col("host")).alias("hn"), F.col("blocked").cast("boolean").alias("bad")).filter("bad IS NOT NULL")
        examples = named.groupBy(F.xxhash64("hn").alias("key")).agg(F.max("bad").alias("bad")).join(keys.filter("kind = 'h'").select("key"), "key", "left_semi")
    examples, examples_path = C.stored(spark, examples, "url-examples")
    host_words = tokens.filter("kind = 'h'").join(examples, "key").select("token", "bad", "n")
    # The distinct paths of a host: counted for each class first, so a path on very many hosts meets its tokens once.
    path_of = narrow.select(F.col("hk").alias("key"), "pk").distinct().join(examples, "key").groupBy(F.col("pk").alias("key"), "bad").agg(F.count(F.lit(1)).alias("hosts"))
    path_words = tokens.filter("kind = 'p'").join(path_of, "key").select("token", "bad", (F.col("n") * F.col("hosts")).alias("n"))
    seen = host_words.unionByName(path_words).groupBy("token").agg(F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("a"))
    seen, seen_path = C.stored(spark, seen, "url-model")
    sums = seen.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.count(F.lit(1)).alias("v")).first()
    classes = examples.agg(F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    prior = math.log((classes["b"] + 1) / (classes["n"] - classes["b"] + 2))
    seeded = F.when(F.col("token").isin(*strong), F.lit(float(SEED_COUNT))).otherwise(0.0) if labels is None else F.lit(0.0)
    odds = F.log((F.col("b") + seeded + 1.0) / (sums["b"] + sums["v"] + 1.0)) - F.log((F.col("a") + 1.0) / (sums["a"] + sums["v"] + 1.0))
    scored = tokens.join(seen.select("token", odds.alias("o")), "token").groupBy("kind", "key").agg(F.sum(F.col("n") * F.col("o")).alias("o"))
    scores, _ = C.stored(spark, keys.select("kind", "key", "pages").join(scored, ["kind", "key"], "left").withColumn("o", F.coalesce("o", F.lit(0.0))), "url-scores")
    part = lambda kind, key, to: scores.filter(F.col("kind") == kind).select(F.col("key").alias(key), F.col("o").alias(to), "pages")
    out = C.join_spread(spark, narrow.drop("hn", "pn"), part("h", "hk", "oh"), "hk", "pages").drop("pages")
    out, _ = C.stored(spark, out, "url-hosts-scored")
    out = C.join_spread(spark, out, part("p", "pk", "op"), "pk", "pages")
    C.drop_paths(spark, pages_path, keys_path, counts_path, words_path, tokens_path, examples_path, seen_path)
    score = F.lit(prior) + F.col("oh") + F.col("op")
    verdict = F.coalesce("said", F.when(score > 0, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), score.alias("log_odds"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, C.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
