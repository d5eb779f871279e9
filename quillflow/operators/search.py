"""Full-text search: a row predicate, stored postings and BM25 ranks.

The search text is the usual web form: words must all occur, "quoted words" form a phrase, `or`
separates alternatives, a leading minus excludes. Words are lower case and unstemmed unless a
`stem` expression is given, for instance `functions.stems.english`; very common words are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WORD, bind
from ..functions.words import merged_terms, positions_by_word
from ..lexicons import SEARCH_STOP_WORDS
from ..session import written
from .articles import search_page

BM25_K1 = 1.2
BM25_B = 0.75
BUCKETS = 64
BLOCKS_PER_CLASS = 16
Stem = Callable[[Column], Column]


def tokens(text: Column, stem: Stem | None = None, stop_words: Sequence[str] = ()) -> Column:
    """Words of a text in order. With `stem` their stems; a stop word then leaves an empty place."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+"), 0)
    return words if stem is None else F.transform(words, lambda w: F.when(~w.isin(list(stop_words)), stem(w)))


def search_terms(search: str, stop_words: Sequence[str] = tuple(SEARCH_STOP_WORDS)) -> list[list[tuple[bool, list]]]:
    """Alternatives of (wanted, words); a stop word inside a phrase stays as a gap (None)."""
    stops = set(stop_words)
    alternatives: list[list[tuple[bool, list]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', search.lower()):
        if word == "or" and not minus:
            alternatives.append([])
            continue
        words = [None if w in stops else w for w in re.findall(r"\w+", phrase or word)]
        while words and words[0] is None:
            words.pop(0)
        while words and words[-1] is None:
            words.pop()
        if words:
            alternatives[-1].append((not minus, words))
    return [a for a in alternatives if a]


def _stems(spark: SparkSession, words: Sequence[str], stem: Stem | None) -> dict[str, str]:
    """Stem of each word of a search, by the same expression as in the index."""
    if stem is None or not words:
        return {w: w for w in words}
    return dict(zip(words, spark.range(1).select(F.array(*[stem(F.lit(w)) for w in words])).first()[0]))


def _pattern(words: list) -> str:
    middle = rf"[^{WORD}]+".join(rf"[{WORD}]+" if w is None else w for w in words)
    return rf"(?<![{WORD}]){middle}(?![{WORD}])"


def text_match(
    search: str, text: Column, stop_words: Sequence[str] = tuple(SEARCH_STOP_WORDS), stem: Stem | None = None
) -> Column:
    """Predicate: does `text` satisfy the search? Nothing matches a search of stop words only."""
    alternatives = search_terms(search, stop_words)
    if not alternatives:
        return F.lit(False)
    if stem is not None:
        return bind(tokens(text, stem, stop_words), lambda found: _any_holds(
            alternatives, lambda words: _words_at(found, words, stem)))
    low = F.lower(text)

    return _any_holds(alternatives, lambda words: low.rlike(_pattern(words)))


def _any_holds(alternatives: list, found: Callable[[list], Column]) -> Column:
    """One of the alternatives holds: all its wanted parts are found and none of the others."""
    return reduce(Column.__or__, [
        reduce(Column.__and__, [found(words) if yes else ~found(words) for yes, words in option])
        for option in alternatives])


def _words_at(held: Column, words: list, stem: Stem) -> Column:
    """The words stand one after the other in the token array; a gap is any token."""
    if len(words) == 1:
        return F.coalesce(F.array_contains(held, stem(F.lit(words[0]))), F.lit(False))
    places = F.sequence(F.lit(0), F.size(held) - F.lit(len(words)))
    here = lambda i: reduce(Column.__and__, [
        F.coalesce(F.get(held, i + k) == stem(F.lit(w)), F.lit(False)) for k, w in enumerate(words) if w])
    return F.when(F.size(held) >= len(words), F.exists(places, here)).otherwise(False)


def build_postings(
    articles: DataFrame,
    text: Column | None = None,
    stop_words: Sequence[str] = tuple(SEARCH_STOP_WORDS),
    stem: Stem | None = None,
) -> DataFrame:
    """One row per (term, article): count, positions, article length in words and the article's block.

    An article's words are counted inside its row, so building the postings needs no shuffle. Stop
    words are told before stemming. Store the rows with `write_postings`.
    """
    return described_postings(listed_postings(articles, text, stop_words, stem))


def listed_postings(
    articles: DataFrame,
    text: Column | None = None,
    stop_words: Sequence[str] = tuple(SEARCH_STOP_WORDS),
    stem: Stem | None = None,
) -> DataFrame:
    """Postings without the columns that `described_postings` tells from the others, so that they need not be shuffled."""
    text = F.concat_ws(" ", "title", "summary", "body") if text is None else text
    stops = list(stop_words)
    counted = positions_by_word(tokens(text), lambda w: ~w.isin(stops))
    listed = articles.select("id", (counted if stem is None else bind(counted, lambda p: merged_terms(p, stem))).alias("_p"))
    length = F.aggregate("_p", F.lit(0), lambda total, p: total + p["tf"])
    # The length is taken before the terms are spread out, or it would be summed once per term.
    sized = listed.withColumn("doc_len", length)
    spread = sized.select("id", "doc_len", F.explode_outer("_p").alias("p")).filter(F.col("p").isNotNull())
    return spread.select("p.term", "id", "doc_len", "p.positions")


def described_postings(listed: DataFrame) -> DataFrame:
    """Adds count and block to listed postings; other columns that they have come last."""
    more = [c for c in listed.columns if c not in ("term", "id", "doc_len", "positions")]
    return listed.select(
        "term", "id", F.size("positions").cast("bigint").alias("tf"), "doc_len", "positions", _block().alias("doc_block"), *more)


def _block() -> Column:
    """Articles of one length class (by powers of the square root of two) and hash: of short ones a word tells more."""
    length_class = F.floor(F.log2(F.greatest("doc_len", F.lit(1)).cast("double")) * 2)
    return (length_class * BLOCKS_PER_CLASS + _slot()).cast("int")


def _slot() -> Column:
    return F.pmod(F.xxhash64("id", F.lit("block")), F.lit(BLOCKS_PER_CLASS))


def article_shares(articles: DataFrame, shares: int) -> list[DataFrame]:
    """The articles in `shares` parts of about one size (a divisor of `BLOCKS_PER_CLASS`); no block lies in two of them."""
    return [articles.filter(_slot() % shares == k) for k in range(shares)] if shares > 1 else [articles]


def posting_blocks(postings: DataFrame) -> DataFrame:
    """(term, doc_block) with what bounds any gain in it: articles, highest count, least length."""
    return postings.groupBy("term", "doc_block").agg(
        F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"))


def bucketed(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("term_bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))


def write_postings(postings: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace what `path` holds: partitioned by term bucket; large buckets are split over several files.

    An index that grows with every run has a folder for each, `run_id=<run>` under one root.
    """
    # Sorted by block inside a term: a filter on both skips pages that hold other blocks.
    order = ["term_bucket", "term", *(c for c in ("doc_block",) if c in postings.columns)]
    (bucketed(postings, buckets).hint("rebalance", "term_bucket")
     .sortWithinPartitions(*order).write.mode("overwrite")
     .partitionBy("term_bucket").parquet(path))


def read_postings(spark, path: str, search: str, buckets: int = BUCKETS, stem: Stem | None = None) -> DataFrame:
    """Postings that the search can need: bucket pruning first, then the term filter."""
    return needed_postings(spark.read.parquet(path), search, buckets, stem)


def needed_postings(held: DataFrame, search: str, buckets: int = BUCKETS, stem: Stem | None = None) -> DataFrame:
    wanted = sorted(set(_stems(held.sparkSession, _all_words(search), stem).values()))
    if not wanted:
        return held.filter(F.lit(False))
    # The same expression over literals: folded when the plan is made, so partitions are pruned.
    hit = reduce(Column.__or__, [
        F.col("term_bucket") == F.pmod(F.xxhash64(F.lit(w)), F.lit(buckets)).cast("int") for w in wanted])
    return held.filter(hit & F.col("term").isin(wanted))


def _all_words(search: str) -> list[str]:
    return sorted({w for option in search_terms(search) for _, words in option for w in words if w})


def doc_lengths(articles: DataFrame, text: Column | None = None, stop_words: Sequence[str] = tuple(SEARCH_STOP_WORDS),
                stem: Stem | None = None) -> DataFrame:
    """(id, doc_len) of every article, also of those without a word; kept beside the postings."""
    text = F.concat_ws(" ", "title", "summary", "body") if text is None else text
    length = F.size(F.filter(tokens(text), lambda w: ~w.isin(list(stop_words))))
    return articles.select("id", length.cast("bigint").alias("doc_len"))


def index_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of articles and mean length."""
    return lengths.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("mean_len"))


def corpus_stats(articles: DataFrame, text: Column | None = None, stop_words: Sequence[str] = tuple(SEARCH_STOP_WORDS),
                 stem: Stem | None = None) -> DataFrame:
    """`index_stats` straight from the articles."""
    return index_stats(doc_lengths(articles, text, stop_words, stem))


def _phrase_at(words: list) -> Column:
    """Does the phrase occur, given one positions column per word?"""
    later = [(k, w) for k, w in enumerate(words) if k and w]
    follows = lambda p: reduce(Column.__and__, [F.array_contains(F.col(f"p_{w}"), p + k) for k, w in later])
    return F.coalesce(F.exists(F.col(f"p_{words[0]}"), follows), F.lit(False))


def _stemmed_options(spark: SparkSession, search: str, stem: Stem | None) -> list:
    options = search_terms(search)
    if any(all(not yes for yes, _ in option) for option in options):
        raise ValueError("every alternative of an indexed search needs at least one wanted word")
    stems = _stems(spark, _all_words(search), stem)
    return [[(yes, [w and stems[w] for w in words]) for yes, words in option] for option in options]


def _matched(hits: DataFrame, options: list, *more: Column) -> DataFrame:
    """Ids of the articles that satisfy the options, from the postings of their terms.

    Everything about one article is one grouped row, so a term that occurs everywhere is still
    spread by article. Only the words of phrases carry their positions through the shuffle.
    """
    parts = [words for option in options for _, words in option]
    words = sorted({w for part in parts for w in part if w})
    placed = sorted({w for part in parts if len(part) > 1 for w in part if w})
    per_article = hits.groupBy("id").agg(
        *more,
        *[F.bool_or(F.col("term") == w).alias(f"h_{w}") for w in words],
        *[F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p_{w}") for w in placed])
    found = lambda part: F.col(f"h_{part[0]}") if len(part) == 1 else _phrase_at(part)
    return per_article.filter(_any_holds(options, found))


def search_ids(postings: DataFrame, search: str, stem: Stem | None = None) -> DataFrame:
    """Ids of the articles that match the search, through the index."""
    options = _stemmed_options(postings.sparkSession, search, stem)
    if not options:
        return postings.select("id").filter(F.lit(False))
    words = sorted({w for option in options for _, part in option for w in part if w})
    return _matched(postings.filter(F.col("term").isin(words)), options).select("id")


def search_ranked(
    articles: DataFrame, postings: DataFrame, stats: DataFrame, search: str, stem: Stem | None = None,
    frequencies: DataFrame | None = None,
) -> DataFrame:
    """Articles that match the search, with their BM25 `rank` over the wanted words.

    The term filter reaches the postings scan. `stem` is the one the index was built with. `frequencies` (term, df)
    are needed where `postings` are a part of the index only.
    """
    options = _stemmed_options(articles.sparkSession, search, stem)
    if not options:
        return articles.withColumn("rank", F.lit(0.0)).filter(F.lit(False))
    words = sorted({w for option in options for _, part in option for w in part if w})
    wanted = sorted({w for option in options for yes, part in option if yes for w in part if w})
    hits = postings.filter(F.col("term").isin(words))
    # One row: how many articles hold each term. Bounded by the words of the search.
    spread = hits.groupBy("term").agg(F.count("*").alias("df")) if frequencies is None else frequencies
    n_docs, mean_len = stats.select("n_docs").scalar(), stats.select("mean_len").scalar()
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = spread.filter(F.col("term").isin(wanted)).select("term", idf.alias("idf"))
    gain = _gain(F.col("idf"), F.col("tf"), F.col("doc_len"), mean_len)
    # Broadcast is safe: the weights have one row per word of the search at most.
    scored = hits.join(F.broadcast(weights), "term", "left").withColumn("_gain", F.coalesce(gain, F.lit(0.0)))
    matched = _matched(scored, options, F.sum("_gain").alias("rank"))
    return articles.join(matched.select("id", "rank"), "id")


def _gain(idf: Column, tf: Column, doc_len: Column, mean_len: Column) -> Column:
    norm = BM25_K1 * (1 - BM25_B + BM25_B * doc_len / mean_len)
    return idf * tf * (BM25_K1 + 1) / (tf + norm)


def block_bounds(blocks: DataFrame, stats: DataFrame, search: str, stem: Stem | None = None) -> list[tuple[int, float]]:
    """(doc_block, bound) of the blocks that can hold a match, highest bound first.

    A block's bound is the sum, over the wanted words, of the largest gain that its highest count and least length allow. A
    block without all wanted words of some alternative holds no match. Read from the block table alone: a row per word
    of the search and block.
    """
    options = _stemmed_options(blocks.sparkSession, search, stem)
    wanted = sorted({w for option in options for yes, part in option if yes for w in part if w})
    if not wanted:
        return []
    held = blocks.filter(F.col("term").isin(wanted)).groupBy("term", "doc_block").agg(
        F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
    total = held.groupBy("term").agg(F.sum("df").alias("df"))
    n_docs, mean_len = stats.select("n_docs").scalar(), stats.select("mean_len").scalar()
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    bound = _gain(F.col("idf"), F.col("max_tf"), F.col("min_len"), mean_len)
    per_block = held.drop("df").join(total.select("term", idf.alias("idf")), "term").groupBy("doc_block").agg(
        F.sum(F.greatest(bound, F.lit(0.0))).alias("bound"), F.collect_set("term").alias("terms"))
    found = []
    for row in per_block.collect():
        terms = set(row["terms"])
        if any(all(w in terms for yes, part in option if yes for w in part if w) for option in options):
            found.append((row["doc_block"], row["bound"] * (1 + 1e-9)))  # sums of doubles may differ in their last bits
    return sorted(found, key=lambda b: (-b[1], b[0]))


FIRST_WAVE = 8


def search_top(
    articles: DataFrame, postings: DataFrame, blocks: DataFrame, stats: DataFrame, search: str, limit: int,
    cursor: tuple | None = None, stem: Stem | None = None, first_wave: int = FIRST_WAVE,
    told: Callable[[list[int]], None] | None = None,
) -> DataFrame:
    """The page that `search_page` gives over `search_ranked`, without ranking every match.

    All postings of an article lie in its block, so a block's matches are ranked completely by reading it alone. Blocks are
    read in waves, highest bound first, each wave twice the one before; once the page is full, a block whose bound is
    below the page's last rank can't add to it and is never read. `told` hears which blocks each wave reads.
    """
    left = block_bounds(blocks, stats, search, stem)
    words = sorted({w for option in _stemmed_options(articles.sparkSession, search, stem) for _, part in option for w in part if w})
    known = blocks.filter(F.col("term").isin(words)).groupBy("term").agg(F.sum("df").alias("df"))
    # Waves carry what orders the page; the articles are joined to the page alone.
    placed, page, size = articles.select("id", "published_at"), None, first_wave
    while left:
        wave, left, size = [b for b, _ in left[:size]], left[size:], size * 2
        if told:
            told(wave)
        ranked = search_ranked(placed, postings.filter(F.col("doc_block").isin(wave)), stats, search, stem, known)
        best = search_page(ranked, limit, cursor)
        page = written(best if page is None else search_page(page.unionByName(best), limit), "page")
        ranks = sorted((r["rank"] for r in page.select("rank").collect()), reverse=True)
        if len(ranks) > limit:
            left = [(b, bound) for b, bound in left if bound >= ranks[limit]]
    if page is None:
        return search_page(articles.withColumn("rank", F.lit(0.0)).filter(F.lit(False)), limit)
    return search_page(articles.join(page.select("id", "rank").distinct(), "id"), limit, cursor)
