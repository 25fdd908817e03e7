"""Occurrences of many terms inside many texts, in any language.

Terms are found as plain substrings of the lower-cased text, wherever they stand and however often they
overlap, as a character-trigram index finds them.  One automaton over the terms reads every text once;
a longer list of terms is dealt into blocks of bounded size, one pass over the texts each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, spread

#: Bytes of terms that one pass looks for; what is sent to every task is bounded by it.
BLOCK_BYTES = 16 << 20


def term_blocks(terms: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[str]]:
    """The distinct values of ``term`` in blocks of about ``block_bytes``, dealt by hash."""
    distinct = settle(terms.select("term").filter("term <> ''").distinct())
    total = distinct.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        block = [r[0] for r in distinct.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k).collect()]
        if block:
            yield block


def term_hits(docs: DataFrame, terms: DataFrame, key: str, fields: Sequence[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``field, key, term, hits``: how often each ``term`` (lower case) occurs in each field of each row.
    Occurrences may overlap.  Null fields hold nothing; empty terms are never found."""
    named = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.coalesce(f, F.lit(""))).alias("body")) for f in fields]))
    bodies = spread(docs.select(key, *fields)).select(F.col(key).alias("_key"), named.alias("n")).select("_key", "n.field", "n.body")
    schema = f"field string, _key {bodies.schema['_key'].dataType.simpleString()}, term string, hits bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in term_blocks(terms, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for number, term in enumerate(sent.value):
                automaton.add_word(term, number)
            automaton.make_automaton()
            names = pa.array(sent.value, pa.string())
            for batch in batches:
                row, term, hits = [], [], []
                for k, body in enumerate(batch.column(2).to_pylist()):
                    found = Counter(map(itemgetter(1), automaton.iter(body)))
                    row += [k] * len(found)
                    term += found.keys()
                    hits += found.values()
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(0).take(at), names.take(pa.array(term, pa.int64())), pa.array(hits, pa.int64())], names=["field", "_key", "term", "hits"])
        out = out.unionByName(bodies.mapInArrow(run, schema))
    return out.withColumnRenamed("_key", key)


def substring_search(entries: DataFrame, queries: DataFrame, qid: str, key: str, k: int) -> DataFrame:
    """``qid, key, score, rank``: how many blank-separated words of the query (a repeated word counts each
    time) lie anywhere in the entry's ``title`` and ``summary``; underscores count as blanks.  Ties by id."""
    plain = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit(" ")))
    words = F.filter(F.split(F.trim(plain(F.col("text"))), "\\s+"), lambda w: w != "")
    asked = settle(queries.select(qid, F.explode(words).alias("term")).groupBy(qid, "term").agg(F.count(F.lit(1)).alias("times")))
    body = entries.select(key, plain(F.concat_ws(" ", "title", "summary")).alias("body"))
    found = term_hits(body, asked, key, ["body"]).select(key, "term")
    scored = found.join(asked, "term").groupBy(qid, key).agg(F.sum("times").alias("score"))
    return best_of(scored, qid, key, F.col("score"), k)


def best_of(scored: DataFrame, qid: str, key: str, order: Column, k: int) -> DataFrame:
    """The best ``k`` rows per query with their ``rank``; ties by ``key``.  Each task cuts its own rows to
    ``k`` before they are sent to the query's task."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(order.desc(), key)))
    return ranked.filter(F.col("rank") <= k)
