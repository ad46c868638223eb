"""Intent memory: keys, grading, retention, recall; transcripts are in sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.snapshot import beside, latest

RECALL, KEPT = 0.45, 12
#: Beginnings of user text that a program wrote; fixed values of the data's definition.
MACHINE = (
    "^\\s*(?:\\[SYSTEM NOTIFICATION|# AGENTS\\.md instructions|<(?:task-notification|system-reminder|local-command-stdout"
    "|command-name|command-message|recommended_plugins|environment_context|user_instructions|permissions instructions)(?![A-Za-z0-9_]))"
)


def resolved(messages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Messages with session_id in lower case and the role that its spelling, trimmed and case-folded, has in (alias, role).

    A spelling that is not there stands for itself, as all do without a table.
    """
    spelling = F.lower(F.trim("role"))
    rows = messages.withColumn("session_id", F.lower("session_id")) if "session_id" in messages.columns else messages
    if aliases is None:
        return rows.withColumn("role", spelling)
    known = aliases.select(F.lower(F.trim("alias")).alias("__alias"), F.lower(F.trim("role")).alias("__role")).where("__alias is not null").dropDuplicates(["__alias"])
    named = rows.withColumn("__spelling", spelling).join(F.broadcast(known), F.col("__spelling") == F.col("__alias"), "left")
    return named.withColumn("role", F.coalesce("__role", "__spelling")).drop("__spelling", "__alias", "__role")


def user_turns(messages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """User rows, by any spelling of the role, with text that no program wrote."""
    return resolved(messages, aliases).where((F.col("role") == "user") & F.col("text").isNotNull() & F.col("text").rlike("[^ \\t\\r\\n]") & ~F.col("text").rlike(MACHINE))


def recorded(messages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(id, normalized, frequency, first_seen, last_seen): the intents of the user turns; turns without terms are left out."""
    turns = user_turns(messages, aliases).select(F.array_join(T.intent_terms("text"), " ").alias("normalized"), "created_at").where("normalized <> ''")
    per = turns.groupBy("normalized").agg(F.count("*").alias("frequency"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    return per.select(T.intent_key(F.col("normalized")).alias("id"), "normalized", "frequency", "first_seen", "last_seen")


def graded_turns(messages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(session_id, seq, outcome, score) of each user turn by the next one: re-asked, rejected or accepted. The last of a session has none."""
    turns = latest(user_turns(messages, aliases).where("session_id is not null and seq is not null"), ["session_id", "seq"], "created_at", ["id"])
    rows = beside(turns.select("session_id", "seq", "text"), "session_id", "seq", ["text"]).withColumn("next", F.col("__beside.text")).where("next is not null")
    rows = rows.withColumn("sim", T.jaccard(F.array_distinct(T.intent_terms("text")), F.array_distinct(T.intent_terms("next"))))
    yes, no = T.accepts(F.col("next")), T.rejects(F.col("next"))
    bad, half = no | ((F.col("sim") >= 0.6) & ~yes), (F.col("sim") >= 0.35) & ~yes
    score = F.when(bad, T.half_up(F.greatest(F.lit(0.0), 0.3 - F.col("sim") * 0.3), 3)).when(half, 0.5).when(yes, 0.9).otherwise(0.7)
    return rows.select("session_id", "seq", F.when(bad, "unresolved").when(half, "partial").otherwise("resolved").alias("outcome"), score.alias("score"))


def retained(resolutions: DataFrame) -> DataFrame:
    """The rows that an intent keeps: the 12 of the best scores (then of the greatest id), and the newest."""
    once = latest(resolutions.where("intent_id is not null and id is not null"), ["id"], "ts", [F.xxhash64("response_excerpt")])
    best = Window.partitionBy("intent_id").orderBy(F.desc_nulls_last("score"), F.desc("id"))
    newest = Window.partitionBy("intent_id").orderBy(F.desc("id"))
    rows = once.withColumn("r", F.row_number().over(best)).withColumn("m", F.row_number().over(newest))
    return rows.where(f"r <= {KEPT} or m = 1").drop("r", "m")


def recall(intents: DataFrame, queries: DataFrame, topk: int = 5, least: float = RECALL) -> DataFrame:
    """(query_id, id, score, rank): the stored intents most similar to each query, both (id, text), by Jaccard of terms.

    Two sets of a similarity of `least` share one of their rarest terms: of a set of m terms the m - ceil(least m) + 1
    rarest. So only pairs that meet there are compared; frequent terms bring no pairs, and none is missed.
    """
    terms = lambda df: df.select("id", F.explode(F.array_distinct(T.intent_terms("text"))).alias("term"))
    stored, asked = terms(intents), terms(queries)
    df = stored.groupBy("term").agg(F.count("*").alias("df"))

    def prefix(ts: DataFrame) -> tuple[DataFrame, DataFrame]:
        known = ts.join(df, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
        sets = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("s")).select("id", F.transform("s", lambda x: x["term"]).alias("s"))
        m = F.size("s")
        return sets, sets.select("id", F.explode(F.slice("s", 1, (m - F.ceil(m * least) + 1).cast("int"))).alias("term"))

    sets, rare = prefix(stored)
    qsets, qrare = prefix(asked)
    pairs = qrare.withColumnRenamed("id", "query_id").join(rare, "term").select("query_id", "id").distinct().where("query_id <> id")
    full = pairs.join(qsets.toDF("query_id", "q"), "query_id").join(sets, "id")
    scored = full.select("query_id", "id", T.half_up(T.jaccard(F.col("q"), F.col("s")), 3).alias("score"), T.jaccard(F.col("q"), F.col("s")).alias("raw"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("raw"), "id"))
    return scored.where(F.col("raw") >= least).withColumn("rank", rank).where(F.col("rank") <= topk).drop("raw")


TEXT_KEPT, EXCERPT_KEPT = 500, 600
# Outcomes that a resolution may have.
OUTCOMES = ("resolved", "partial", "unresolved", "unknown")


def record(stored: DataFrame, turns: DataFrame) -> DataFrame:
    """The store of intents (id, intent_text, frequency, first_seen, last_seen, first_session, last_session) after the turns (text, session, at).

    A turn's id is that of its terms; turns without terms are left out. A known intent counts the turns on top, takes the
    newest text, at most 500 characters of it, and the last session; an unknown one begins. Ties of time go to the greatest session, then text.
    """
    rows = turns.select(F.array_join(T.intent_terms("text"), " ").alias("n"), F.substring("text", 1, TEXT_KEPT).alias("text"), "session", "at").where("n <> ''")
    new = rows.groupBy(T.intent_key(F.col("n")).alias("id")).agg(
        F.count("*").alias("frequency"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"),
        F.max(F.struct("at", "session", "text")).alias("last"), F.min(F.struct("at", "session")).alias("first"),
    ).select("id", F.col("last.text").alias("intent_text"), "frequency", "first_seen", "last_seen", F.col("first.session").alias("first_session"), F.col("last.session").alias("last_session"))
    both = stored.select("id", "intent_text", "frequency", "first_seen", "last_seen", "first_session", "last_session").unionByName(new)
    newest = lambda c: F.max_by(c, F.struct("last_seen", "frequency"))
    return both.groupBy("id").agg(
        newest("intent_text").alias("intent_text"), F.sum("frequency").cast("long").alias("frequency"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min_by("first_session", "first_seen").alias("first_session"), newest("last_session").alias("last_session"),
    )


def picked(resolutions: DataFrame) -> DataFrame:
    """The row of each intent that a grade goes to: one that is not graded before graded ones, then the greatest id."""
    w = Window.partitionBy("intent_id").orderBy(F.coalesce("graded", F.lit(False)), F.desc("id"))
    return resolutions.where("intent_id is not null and id is not null").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def graded(resolutions: DataFrame, grades: DataFrame) -> DataFrame:
    """Resolutions after grades (intent_id, outcome, score, grader, excerpt), one per intent.

    The row that `picked` gives takes the grade; its excerpt only where it has none, at most 600 characters of it. An
    unknown outcome becomes `unknown`, a score is put between 0 and 1. An intent without rows gets one, with ids above all others.
    """
    said = F.lower(F.trim("outcome"))
    news = grades.groupBy("intent_id").agg(F.max(F.struct("score", "outcome", "grader", "excerpt")).alias("g")).select("intent_id", "g.*")
    news = news.select("intent_id", F.when(said.isin(*OUTCOMES), said).otherwise("unknown").alias("o"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)))).alias("s"), F.col("grader").alias("g"), F.substring("excerpt", 1, EXCERPT_KEPT).alias("e"))
    target = picked(resolutions).select("id", "intent_id").join(news, "intent_id").drop("intent_id")
    joined = resolutions.join(target, "id", "left")
    hit = F.col("o").isNotNull()
    bare = F.coalesce("response_excerpt", F.lit("")) == ""
    old = joined.select(
        "id", "intent_id", F.when(hit & bare, F.coalesce("e", "response_excerpt")).otherwise(F.col("response_excerpt")).alias("response_excerpt"), F.coalesce("o", "outcome").alias("outcome"),
        F.when(hit, F.col("s")).otherwise(F.col("score")).alias("score"), F.coalesce("g", "grader").alias("grader"), (hit | F.coalesce("graded", F.lit(False))).alias("graded"),
    )
    top = resolutions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = news.join(resolutions.select("intent_id"), "intent_id", "left_anti").withColumn("n", F.monotonically_increasing_id() + 1)
    added = fresh.join(F.broadcast(top)).select((F.col("top") + F.col("n")).alias("id"), "intent_id", F.col("e").alias("response_excerpt"), F.col("o").alias("outcome"), F.col("s").alias("score"), F.col("g").alias("grader"), F.lit(True).alias("graded"))
    return old.unionByName(added)


def attached(resolutions: DataFrame, answers: DataFrame) -> DataFrame:
    """Resolutions after answers (intent_id, text): the newest row of an intent takes the text, at most 600 characters of it, if it has none."""
    texts = answers.where("text is not null").groupBy("intent_id").agg(F.substring(F.max("text"), 1, EXCERPT_KEPT).alias("__e"))
    newest = resolutions.groupBy("intent_id").agg(F.max("id").alias("__id")).join(texts, "intent_id").select(F.col("__id").alias("id"), "__e")
    joined = resolutions.join(newest, "id", "left")
    take = F.col("__e").isNotNull() & (F.coalesce("response_excerpt", F.lit("")) == "")
    return joined.withColumn("response_excerpt", F.when(take, F.col("__e")).otherwise(F.col("response_excerpt"))).drop("__e")


def best_resolutions(resolutions: DataFrame) -> DataFrame:
    """(intent_id, best): the resolution with an answer of the best score of each intent; ties go to the greatest id."""
    rows = resolutions.where("intent_id is not null and response_excerpt is not null and response_excerpt <> ''")
    cells = F.struct(F.coalesce("score", F.lit(-1.0)).alias("score"), "id", "outcome", F.substring("response_excerpt", 1, EXCERPT_KEPT).alias("excerpt"))
    return rows.groupBy("intent_id").agg(F.max(cells).alias("best"))


def recall_scoped(intents: DataFrame, resolutions: DataFrame, asked: DataFrame, topk: int = 5, least: float = RECALL) -> DataFrame:
    """(query_id, rank, id, score, own, best): stored intents (id, text, project) for each of (id, text, project), best known first.

    An intent of the query's own key scores 1, others by Jaccard of their terms, from `least` on. Those of the query's
    project come first, then by score and id; each has its best resolution. Nothing finds itself by row.
    """
    terms = F.array_join(T.intent_terms("text"), " ")
    key = F.when(terms != "", T.intent_key(terms))  # without terms nothing is known
    exact = asked.select(F.col("id").alias("query_id"), key.alias("k")).join(intents.select("id", key.alias("k")), "k").select("query_id", "id", F.lit(1.0).alias("score")).where("query_id <> id")
    near = recall(intents, asked, 1 << 30, least).select("query_id", "id", "score")
    both = exact.unionByName(near).groupBy("query_id", "id").agg(F.max("score").alias("score"))
    placed = both.join(asked.select(F.col("id").alias("query_id"), F.col("project").alias("__own")), "query_id").join(intents.select("id", "project"), "id")
    rows = placed.select("query_id", "id", "score", (F.coalesce("project", F.lit("")) == F.coalesce("__own", F.lit(""))).alias("own"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("own"), F.desc("score"), "id"))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= topk)
    return top.join(best_resolutions(resolutions), top["id"] == F.col("intent_id"), "left").select("query_id", "rank", "id", "score", "own", F.col("best.id").alias("best"))


def injections(intents: DataFrame, resolutions: DataFrame, budget: int = 400) -> DataFrame:
    """(intent_id, text): a note on each intent (id, text, frequency) for a prompt: a heading, the best answer that resolved it and
    one that failed, as whole lines within a budget of four characters a token. Intents without answers have the heading only."""
    line = lambda mark, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(mark), T.oneline(F.col(c), 240)))
    rows = resolutions.where("response_excerpt is not null and response_excerpt <> ''").withColumn("o", F.lower(F.trim("outcome")))
    first = lambda o: F.max(F.when(F.col("o") == o, F.struct(F.coalesce("score", F.lit(-1.0)).alias("s"), "id", "response_excerpt")))["response_excerpt"]
    per = rows.groupBy("intent_id").agg(first("resolved").alias("good"), first("unresolved").alias("bad"))
    all_ = intents.join(per, intents["id"] == per["intent_id"], "left")
    heading = F.concat(F.lit("Asked before ("), F.col("frequency").cast("string"), F.lit("x): "), T.oneline(F.col("text"), 200))
    lines = F.array_compact(F.array(heading, line("+ ", "good"), line("- ", "bad")))
    fold = F.aggregate(lines, F.lit(""), lambda acc, x: F.when(acc == "", x).when(F.length(acc) + 1 + F.length(x) <= 4 * budget, F.concat(acc, F.lit("\n"), x)).otherwise(acc))
    return all_.select(F.col("id").alias("intent_id"), fold.alias("text"))


def last_messages(messages: DataFrame, n: int = 8, aliases: DataFrame | None = None) -> DataFrame:
    """The last n messages of each session by number, of repeated numbers the latest."""
    rows = latest(resolved(messages, aliases).where("session_id is not null and seq is not null"), ["session_id", "seq"], "created_at", ["id"])
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("seq")))
    return rows.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")
