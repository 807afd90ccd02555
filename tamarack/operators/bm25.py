"""BM25 index and ranking (R01, R02, R04) as joins and counts over postings.

Documents are tokenized once: a kept table has a row for each document with those of its words that queries ask for, from which number and
mean length of documents, document frequencies and weights for any ``k1`` and ``b`` follow. A document's scores for all queries are summed where its row is, so pairs of
queries and documents are not shuffled, and each task passes on the best of each query alone. A query's documents without any of its terms score 0 and stay
in its ranking, ordered by file: the first ``k`` files of the corpus are enough to fill any ranking, so the corpus is never crossed with the queries.

Rankings sum the weights of all documents that share a term. With ``bounded`` the ``k`` best need not meet every document of every frequent term (``best``): a query's rare terms give a floor under its k-th best score, and the frequent terms that
even together stay below that floor bring no new document in. They are looked up for the documents that are candidates already, by file and term.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarack.functions.text import tokenize
from tamarack.operators.tables import kept, near, parts

K1, B = 1.5, 0.75
#: Postings of a query's rarest terms, as a multiple of k, that give the floor under its k-th best score.
RARE = 20


def postings(docs: DataFrame) -> DataFrame:
    """R01. (file, term, tf) of docs (file, text)."""
    return docs.select("file", F.explode(tokenize(F.coalesce("text", F.lit("")))).alias("term")).groupBy("file", "term").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame) -> DataFrame:
    """R01. (file, dl): the number of tokens."""
    return docs.select("file", F.size(tokenize(F.coalesce("text", F.lit("")))).cast("long").alias("dl"))


def term_counts(posted: DataFrame) -> DataFrame:
    """R01. (term, df): the number of documents that hold a term."""
    return posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf): a term counts as often as the query repeats it. Texts of one query are told apart by a column ``way``, if there is one."""
    names = [c for c in ("query_id", "way") if c in queries.columns]
    return queries.select(*names, F.explode(tokenize(F.coalesce("text", F.lit("")))).alias("term")).groupBy(*names, "term").agg(F.count(F.lit(1)).alias("qtf"))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


@dataclass(frozen=True)
class Index:
    """Documents (file, dl, copies, words, tfs) with their words among those that ``asked`` (query_id, term, word, qtf) has and how often they hold each; ``copies``
    rows had the file and length. ``known``: (word, idf, df). ``whole``: one row (n, avgdl)."""

    held: DataFrame
    asked: DataFrame
    known: DataFrame
    whole: DataFrame


def index(queries: DataFrame, docs: DataFrame) -> Index:
    """R01. The kept index of docs (file, text) for queries (query_id, text); several rows of one query_id are one query."""
    asked = query_terms(queries)
    words = kept(asked.select("term").distinct().withColumn("word", F.monotonically_increasing_id()))
    asked = kept(asked.join(words, "term"))
    # Texts are dealt out by file before they become words, so that nothing else of them is shuffled.
    tokens = docs.select("file", F.coalesce("text", F.lit("")).alias("text")).repartition(parts(docs.sparkSession), "file").select("file", tokenize(F.col("text")).alias("tokens"))
    every = tokens.select("file", F.size("tokens").cast("long").alias("dl"), F.explode(F.array_append("tokens", F.lit(None))).alias("term"))
    met = every.join(near(words), "term", "left").filter("word IS NOT NULL OR term IS NULL")
    posted = met.groupBy("file", "dl", "word").agg(F.count(F.lit(1)).alias("tf"))
    rows = posted.groupBy("file", "dl").agg(F.max(F.when(F.col("word").isNull(), F.col("tf"))).alias("copies"), F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "tf"))).alias("held"))
    held = kept(rows.select("file", "dl", "copies", F.col("held.word").alias("words"), F.transform("held.tf", lambda x: x.cast("int")).alias("tfs")))
    whole = kept(held.agg(F.sum("copies").alias("n"), (F.sum(F.col("dl") * F.col("copies")) / F.sum("copies")).alias("avgdl")))
    df = held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return Index(held, asked, kept(df.crossJoin(F.broadcast(whole)).select("word", _idf(F.col("n"), F.col("df")).alias("idf"), "df")), whole)  # whole: one row


def _postings(held: DataFrame, whole: DataFrame, *columns: str) -> DataFrame:
    """(file, dl, avgdl, word, tf, columns) of documents."""
    rows = held.crossJoin(F.broadcast(whole.select("avgdl"))).select("file", "dl", "avgdl", *columns, F.explode(F.arrays_zip("words", "tfs")).alias("x"))  # whole: one row
    return rows.select("file", "dl", "avgdl", *columns, F.col("x.words").alias("word"), F.col("x.tfs").alias("tf"))


def _weight(k1: float, b: float) -> Column:
    return F.col("idf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def weights(of: Index, *, k1: float = K1, b: float = B) -> DataFrame:
    """(word, file, weight): what a word adds to a document's score."""
    return _postings(of.held, of.whole).join(near(of.known), "word").select("word", "file", _weight(k1, b).alias("weight"))


def _summed(asked: DataFrame, weighed: DataFrame) -> DataFrame:
    return weighed.join(asked, "word").groupBy("query_id", "file").agg(F.sum(F.col("qtf") * F.col("weight")).alias("score"))


def gathered(of: Index, asked: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(query_id, file ...): sums over the words that a document shares with a query. asked: kept (query_id, word, idf ...); the sums may use its columns, dl, avgdl and tf.

    Documents are dealt out by file, and all rows of a pair are in the task that makes them.
    """
    rows = _postings(of.held.repartition(parts(of.held.sparkSession), "file"), of.whole).join(near(asked), "word")
    return rows.groupBy("query_id", "file").agg(*[F.sum(x).alias(n) for n, x in sums.items()])


def terms(of: Index) -> DataFrame:
    """Kept (query_id, word, term, qtf, idf) of the queries' words that a document has."""
    return kept(of.asked.join(of.known, "word").select("query_id", "word", "term", "qtf", "idf"))


def _score(k1: float, b: float) -> Column:
    return F.col("qtf") * _weight(k1, b)


def scored(of: Index, *, k1: float = K1, bs: Sequence[float] = (B,)) -> DataFrame:
    """R04. (query_id, file, score) of all documents that share a term with a query, rounded to 6 places; with several ``bs``: score_0, score_1 ..."""
    names = ["score"] if len(bs) == 1 else [f"score_{i}" for i in range(len(bs))]
    found = gathered(of, terms(of), {n: _score(k1, b) for n, b in zip(names, bs, strict=True)})
    return found.select("query_id", "file", *[F.round(n, 6).alias(n) for n in names])


def scores(queries: DataFrame, docs: DataFrame, *, k1: float = K1, b: float = B) -> DataFrame:
    """R04. (query_id, file, score) of all documents that share a term with a query; score is rounded to 6 places."""
    return scored(index(queries, docs), k1=k1, bs=(b,))


def scores_of(of: Index, pairs: DataFrame, *, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, file, score) as R04, of those of the pairs (query_id, file) that share a term: only these are summed."""
    wanted = kept(pairs.select("query_id", "file").distinct())
    # Documents that no pair names are left out before they are dealt out.
    held = of.held.join(near(kept(wanted.select("file").distinct())), "file", "left_semi").join(wanted, "file")
    rows = _postings(held, of.whole, "query_id").join(near(terms(of)), ["query_id", "word"])
    return rows.groupBy("query_id", "file").agg(F.sum(_score(k1, b)).alias("score")).withColumn("score", F.round("score", 6))


def best(of: Index, k: int, *, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, file, score) as R04, of all documents that may be among a query's ``k`` best, ties included.

    A query's terms from the rarest on, until they have ``RARE`` times k postings together, are scored first: the k-th best of these sums is the floor. Of the others, from
    the least greatest weight on, those whose greatest weights stay below the floor in sum are light. All documents of the remaining terms are candidates;
    light terms only add to those that can still reach the floor. With fewer than k documents there is no floor, and no term is light.
    """
    weighed = kept(weights(of, k1=k1, b=b))
    terms = of.asked.join(weighed.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.max("weight").alias("most")), "word").withColumn("most", F.col("qtf") * F.col("most"))
    by = W.partitionBy("query_id").orderBy("df", "word")
    rare = (F.sum("df").over(by) <= RARE * k) | (F.row_number().over(by) == 1)
    terms = terms.withColumn("rare", rare)
    first = _summed(terms.filter("rare").select("query_id", "word", "qtf"), weighed)
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc()))
    floor = first.withColumn("nth", nth).filter(F.col("nth") == k).select("query_id", F.col("score").alias("floor"))
    light = F.sum("most").over(W.partitionBy("query_id").orderBy("most", "word").rowsBetween(W.unboundedPreceding, 0))
    rest = terms.filter("NOT rare").withColumn("light", light).join(floor, "query_id", "left")
    # Scores are rounded to six places afterwards.
    terms = kept(terms.filter("rare").select("query_id", "word", "qtf", "most", F.lit(False).alias("light"), F.lit(None).cast("double").alias("floor")).unionByName(
        rest.select("query_id", "word", "qtf", "most", (F.col("light") < F.col("floor") - 1e-5).alias("light"), "floor").na.fill(False, ["light"])
    ))
    limits = terms.groupBy("query_id").agg(F.max("floor").alias("floor"), F.coalesce(F.sum(F.when(F.col("light"), F.col("most"))), F.lit(0.0)).alias("more"))
    partial = _summed(terms.filter("NOT light").select("query_id", "word", "qtf"), weighed).join(limits, "query_id")
    reach = partial.filter(F.col("floor").isNull() | (F.col("score") + F.col("more") >= F.col("floor") - 1e-5))
    late = reach.select("query_id", "file").join(terms.filter("light").select("query_id", "word", "qtf"), "query_id").join(weighed, ["word", "file"])
    added = reach.select("query_id", "file", "score").unionByName(late.select("query_id", "file", (F.col("qtf") * F.col("weight")).alias("score")))
    return added.groupBy("query_id", "file").agg(F.round(F.sum("score"), 6).alias("score"))


def shared(of: Index, *, least: int, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, file, score, own) of all documents that share a term with a query; ``own``: the shared terms of ``least`` characters or more."""
    rows = _postings(of.held.repartition(parts(of.held.sparkSession), "file"), of.whole).join(near(terms(of)), "word")
    own = F.collect_set(F.when(F.char_length("term") >= least, F.col("term"))).alias("own")
    return rows.groupBy("query_id", "file").agg(F.round(F.sum(_score(k1, b)), 6).alias("score"), own)


def two_scores(queries: DataFrame, others: DataFrame, docs: DataFrame, *, least: int, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, file, score, context, n_own) of all documents that share a term with a query or with its other text: both scores as R04, 0 where none is shared, and the
    number of terms of ``least`` characters or more that are shared with the query itself."""
    of = index(queries.select("query_id", "text", F.lit(0).alias("way")).unionByName(others.select("query_id", "text", F.lit(1).alias("way"))), docs)
    qtf = [F.coalesce(F.sum(F.when(F.col("way") == i, F.col("qtf"))), F.lit(0)).alias(f"qtf_{i}") for i in (0, 1)]
    asked = kept(of.asked.groupBy("query_id", "word", "term").agg(*qtf).join(of.known, "word").withColumn("own", ((F.char_length("term") >= least) & (F.col("qtf_0") > 0)).cast("long")).drop("term", "df"))
    sums = {"score": F.col("qtf_0") * _weight(k1, b), "context": F.col("qtf_1") * _weight(k1, b), "n_own": F.col("own")}
    found = gathered(of, asked, sums)
    return found.select("query_id", "file", F.round("score", 6).alias("score"), F.round("context", 6).alias("context"), "n_own")


def filled(found: DataFrame, queries: DataFrame, docs: DataFrame, k: int, *, met: DataFrame | None = None) -> DataFrame:
    """found (query_id, file, score) and, for each query, those of the first ``k`` files that it lacks, with score 0. ``met``: pairs that a query does not lack, found's if not given."""
    first = docs.select("file").orderBy("file").limit(k)  # k rows
    ids = queries.select("query_id").distinct()
    filler = ids.crossJoin(F.broadcast(first)).join((found if met is None else met).select("query_id", "file"), ["query_id", "file"], "left_anti").withColumn("score", F.lit(0.0))
    return found.unionByName(filler, allowMissingColumns=True)


def met_first(of: Index, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, file) of those of the first ``k`` files that share a term with a query."""
    first = docs.select("file").orderBy("file").limit(k)  # k rows
    words = of.held.join(F.broadcast(first), "file", "left_semi").select("file", F.explode("words").alias("word"))
    return words.join(of.asked.select("query_id", "word"), "word").select("query_id", "file").distinct()


def rankings(queries: DataFrame, docs: DataFrame, *, k: int = 10, k1: float = K1, bs: Sequence[float] = (B,), of: Index | None = None) -> tuple[DataFrame, ...]:
    """R02. (query_id, rank, file, score) for each of ``bs``, kept, from one pass over the index."""
    of = of or index(queries, docs)
    order = W.partitionBy("way", "query_id").orderBy(F.col("score").desc(), F.col("file"))
    every = scored(of, k1=k1, bs=bs)
    names = [c for c in every.columns if c.startswith("score")]
    ways = every.select("query_id", "file", F.posexplode(F.array(*names)).alias("way", "score"))
    best = kept(ways.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
    return tuple(kept(_placed(best.filter(F.col("way") == i).drop("way", "rank"), queries, docs, k)) for i in range(len(bs)))


def _placed(found: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("file"))
    ranked = filled(found, queries, docs, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "file", "score")


def rank(queries: DataFrame, docs: DataFrame, *, k: int = 10, k1: float = K1, b: float = B, of: Index | None = None, bounded: bool = False) -> DataFrame:
    """R02. (query_id, rank, file, score): the k best documents of each query, ties and zeros by file. ``of``: their index, if it is there.

    ``bounded`` takes the same ranking by way of a floor: more steps, and far fewer pairs where queries hold words of very many documents.
    Ranks follow the rounded score, so that engines that sum in another order agree.
    """
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("file"))
    of = of or index(queries, docs)
    every = best(of, k, k1=k1, b=b) if bounded else scored(of, k1=k1, bs=(b,))
    found = kept(every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)).drop("rank")
    return _placed(found, queries, docs, k)
