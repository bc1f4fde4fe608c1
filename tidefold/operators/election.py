"""Leader election over tables of vote requests.

A request is refused if its voter has seen a later term before; else the voter's
first request of that term whose log is not behind the voter's own is granted, and
so are repeats by the same candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def requests(log: DataFrame) -> DataFrame:
    """Vote requests for trials, from a change log with user and sequence numbers."""
    user, seq = F.col("user_id"), F.col("event_id")
    return log.select(
        (user % 5).alias("voter"), (F.expr("event_id div 500") + user % 3).alias("term"), F.concat(F.lit("node"), (user % 3).cast("string")).alias("candidate"), seq.alias("arrival"),
        (seq % 3).alias("last_log_index"), (user % 4).alias("last_log_term"),
    )


def log_up_to_date(term: Column, index: Column, own_term: Column, own_index: Column) -> Column:
    return (term > own_term) | ((term == own_term) & (index >= own_index))


def decide(asked: DataFrame, own_term: Column | None = None, own_index: Column | None = None) -> DataFrame:
    """asked with granted. own_term, own_index: the last entry of the voter's log.

    When a voter closes a term (the first arrival of any later one) is found from one
    row for each voter and term, so nothing but those rows is sorted.
    """
    own_term, own_index = own_term if own_term is not None else F.lit(1), own_index if own_index is not None else F.lit(1)
    terms = asked.groupBy("voter", "term").agg(F.min("arrival").alias("opened"))
    later = Window.partitionBy("voter").orderBy(F.desc("term")).rowsBetween(Window.unboundedPreceding, -1)
    terms = terms.select("voter", "term", F.min("opened").over(later).alias("closed"))
    rows = asked.join(terms, ["voter", "term"])
    fit = log_up_to_date(F.col("last_log_term"), F.col("last_log_index"), own_term, own_index) & (F.col("closed").isNull() | (F.col("arrival") < F.col("closed")))
    rows = rows.withColumn("fit", fit)
    first = rows.where("fit").groupBy("voter", "term").agg(F.min_by("candidate", "arrival").alias("chosen"))
    return rows.join(first, ["voter", "term"], "left").select(*asked.columns, F.coalesce(F.col("fit") & (F.col("candidate") == F.col("chosen")), F.lit(False)).alias("granted"))


def tally(decided: DataFrame, cluster: int) -> DataFrame:
    """(term, candidate, votes, won): voters of each candidate; won by more than half of the cluster."""
    votes = F.count_distinct("voter")
    return decided.where("granted").groupBy("term", "candidate").agg(votes.alias("votes"), (votes >= cluster // 2 + 1).alias("won"))


def leaders_per_term(tallied: DataFrame) -> DataFrame:
    return tallied.groupBy("term").agg(F.count_if("won").alias("leaders"))


def append_entries(sent: DataFrame) -> DataFrame:
    """sent (node, term, arrival, ...) with success: whether the node takes a leader's message, that is, has seen no later term before.

    As for votes, what closes a term is found from one row for each node and term.
    """
    terms = sent.groupBy("node", "term").agg(F.min("arrival").alias("opened"))
    later = Window.partitionBy("node").orderBy(F.desc("term")).rowsBetween(Window.unboundedPreceding, -1)
    terms = terms.select("node", "term", F.min("opened").over(later).alias("closed"))
    return sent.join(terms, ["node", "term"]).select(*sent.columns, (F.col("closed").isNull() | (F.col("arrival") < F.col("closed"))).alias("success"))


def heartbeats(tallied: DataFrame, peers: DataFrame) -> DataFrame:
    """(node, term, leader): the empty message that the winner of each term sends to every other node of a cluster's peers (peer)."""
    won = tallied.where("won").select("term", F.col("candidate").alias("leader"))
    return peers.select(F.col("peer").alias("node")).join(won, F.col("node") != F.col("leader")).select("node", "term", "leader")


def step_down(seen: DataFrame) -> DataFrame:
    """(node, term): the highest term each node has seen, in which it is a follower."""
    return seen.groupBy("node").agg(F.max("term").alias("term"))


def leader_state(peers: DataFrame, last_index: int) -> DataFrame:
    """(peer, next_index, match_index) of a new leader."""
    return peers.select("peer", F.lit(last_index + 1).cast("long").alias("next_index"), F.lit(0).cast("long").alias("match_index"))


def entry_label(term: Column, index: Column) -> Column:
    return F.concat(F.lit("T"), term.cast("string"), F.lit(":I"), index.cast("string"))


def log_entries(log: DataFrame, entries_a_term: int = 500) -> DataFrame:
    """(index, term, command): a change log as replicated entries whose commands are JSON, values in base64."""
    kind = F.when(F.col("op") == 2, "DELETE").otherwise("PUT").alias("type")
    command = F.to_json(F.struct(kind, F.col("k").alias("key"), F.encode("v", "UTF-8").alias("value")))
    return log.select(F.col("seq").alias("index"), F.expr(f"seq div {entries_a_term}").alias("term"), command.alias("command"))


def read_commands(entries: DataFrame) -> DataFrame:
    """entries with label, type, key and value (text) of their commands; null where a command is no JSON."""
    c = F.from_json("command", "type STRING, key STRING, value BINARY")
    return entries.withColumn("c", c).select("index", "term", entry_label(F.col("term"), F.col("index")).alias("label"), "c.type", "c.key", F.decode("c.value", "UTF-8").alias("value"))
