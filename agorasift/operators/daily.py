"""Daily tables: profiles, token counts, interaction counts, activity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from agorasift.functions import text as T
from agorasift.functions import urls as U
from agorasift.operators.durable import stored
from agorasift.operators.pieces import piece_counts
from agorasift.operators.ranking import number_rows, pick_one

# layer -> (post id column, account column)
LAYERS = {
    "retweet": ("rt_id", "rt_user_id"),
    "quote": ("quote_id", "quote_user_id"),
    "reply": ("reply_id", "reply_user_id"),
}

MOST_TOGETHER = 100_000  # texts of a user that one task may count
TEXTS_PER_TASK = 10_000
FEW_TEXTS = 2
MOST_TESTED = 32  # listed tokens that each piece of a text may be tested for


def unique_users(posts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per user and day: the user columns of the day's first post."""
    rows = posts.select("user_id", "date", "id", *columns)
    return pick_one(rows, ["user_id", "date"], ["id"]).drop("id")


def distinct_posts(posts: DataFrame) -> DataFrame:
    """One row per post id."""
    return posts.dropDuplicates(["id"])


def token_frequency(
    df: DataFrame, tokens: Column | Callable[[Column], Column], by: Sequence[str] = (), text: str | None = None,
    in_place: bool = False,
) -> DataFrame:
    """Occurrences of each token, overall or by the given columns.

    With ``text``, the column of that name is cut at spaces, equal pieces are
    counted, in the tasks first, and only the distinct ones are tokenised.
    ``tokens`` is then a function from a text to its tokens, none of which may
    hold a space or depend on what is behind one (so no n-grams).  With
    ``in_place`` each task tokenises what it counted: equal pieces of several
    tasks are tokenised in each, and only tokens are exchanged.
    """
    if text is None:
        exploded = df.select(*by, F.explode(tokens).alias("token"))
        return exploded.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("frequency"))
    pieces = piece_counts(df, by, text)
    return _tokens_of(pieces if in_place else pieces.groupBy(*by, "_piece").agg(F.sum("_n").alias("_n")), tokens, by)


def _tokens_of(pieces: DataFrame, tokens: Callable[[Column], Column], by: Sequence[str]) -> DataFrame:
    # outer, or Spark tokenises each piece once more to see whether it has any tokens
    words = pieces.select(*by, F.explode_outer(tokens(F.col("_piece"))).alias("token"), "_n").where(F.col("token").isNotNull())
    return words.groupBy(*by, "token").agg(F.sum("_n").alias("frequency"))


def user_token_frequency(
    df: DataFrame, tokens: Column | Callable[[Column], Column], by: Sequence[str] = ("user_id",), text: str | None = None
) -> DataFrame:
    """``token_frequency`` by a user and other columns, the user first.

    Texts are far shorter than their tokens as rows, so the texts of a user
    are brought together and counted there, and counts are not exchanged.
    Users with more than ``MOST_TOGETHER`` texts are counted in all tasks.
    With ``FEW_TEXTS`` texts a user or fewer, texts are tokenised whole.
    """
    user = F.col(by[0])
    sizes = df.groupBy(user.alias("_user")).agg(F.count(F.lit(1)).alias("_n"))
    large = F.when(F.col("_n") > MOST_TOGETHER, F.struct("_user"))
    total, users, large = sizes.agg(F.sum("_n"), F.count(F.lit(1)), F.collect_list(large)).first()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, (total or 0) // TEXTS_PER_TASK + 1)
    few = text is not None and (total or 0) <= FEW_TEXTS * users  # pieces seldom repeat, so counting them first does not pay

    def count(part: DataFrame) -> DataFrame:
        if text is None:
            return token_frequency(part, tokens, by)
        if not few:  # as rows of the texts' own partitions, so that counts are not exchanged
            pieces = part.select(*by, F.explode(F.split(text, " ")).alias("_piece"))
            return _tokens_of(pieces.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_n")), tokens, by)
        # outer, or Spark tokenises each text once more to see whether it has any tokens
        words = part.select(*by, F.explode_outer(tokens(F.col(text))).alias("token")).where(F.col("token").isNotNull())
        return words.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("frequency"))

    if not large:
        return count(df.repartition(tasks, user))
    named = [row[0] for row in large]
    prolific = F.coalesce(user.isin(*[n for n in named if n is not None]), F.lit(None in named))
    return count(df.where(~prolific).repartition(tasks, user)).unionByName(count(df.where(prolific)))


def listed_pieces(df: DataFrame, tokens: Callable[[Column], Column], listed: DataFrame, text: str) -> DataFrame:
    """``(_piece, token, _n)``: the distinct pieces of texts between spaces that hold a listed token, and how often.

    ``listed`` is a small table with a column ``token``; ``tokens`` is as in
    ``token_frequency``.  The table is stored, so that its size is known where
    texts are matched with it.
    """
    pieces = piece_counts(df, (), text).select("_piece").distinct()
    held = pieces.select("_piece", F.explode(tokens(F.col("_piece"))).alias("token"))
    return stored(held.join(listed.select("token").distinct(), "token", "left_semi").groupBy("_piece", "token").agg(
        F.count(F.lit(1)).alias("_n")), "pieces")


def listed_frequency(df: DataFrame, tokens: Callable[[Column], Column], listed: DataFrame, by: Sequence[str],
                     text: str) -> DataFrame:
    """``token_frequency`` of the listed tokens only; no other word is exchanged.

    ``tokens`` is as in ``token_frequency``, by the grammar of
    ``functions.text``.  Texts are read once: a piece that is a plain word is
    its own token, and of the others only those that hold a listed token
    anywhere are cut.  More than ``MOST_TESTED`` tokens are matched as a
    table, in two readings.
    """
    listed = listed.where(F.length("token") > 0).select("token").distinct()
    words = [row[0] for row in listed.limit(MOST_TESTED + 1).collect()]
    # outer, or Spark cuts each text once more to see whether it has any pieces
    pieces = df.select(*by, F.explode_outer(F.split(text, " ")).alias("_piece"))
    if len(words) > MOST_TESTED:
        found = pieces.join(listed_pieces(df, tokens, listed, text), "_piece")
        return found.groupBy(*by, "token").agg(F.sum("_n").alias("frequency"))
    piece = F.col("_piece")
    picked = pieces.where(piece.isin(words) | (~T.is_plain_word(piece) & T.holds_any(piece, words)))
    cut = F.when(T.is_plain_word(piece), F.array(piece)).otherwise(tokens(piece))
    held = picked.select(*by, F.explode_outer(cut).alias("token")).where(F.col("token").isin(words))
    return held.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("frequency"))


def token_totals(user_tokens: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per token: occurrences and users, from unique (user, token) rows."""
    return user_tokens.groupBy(*by, "token").agg(
        F.sum("frequency").alias("total_frequency"), F.count(F.lit(1)).alias("total_users")
    )


def posts_per_user(posts: DataFrame, by: Sequence[str] = ("user_id",)) -> DataFrame:
    """Distinct posts of each user."""
    return posts.select("id", *by).dropDuplicates(["id"]).groupBy(*by).agg(F.count(F.lit(1)).alias("posts"))


def posts_list_per_user(posts: DataFrame, chunk: int = 1000) -> DataFrame:
    """Texts of each user in id order, as lists of at most ``chunk`` posts.

    A prolific user gets several rows, so no task ever builds one huge list;
    the rows of a user joined by ``part`` give the whole list.
    """
    placed = number_rows(posts.select("user_id", "id"), [F.col("id")], "_at", within=["user_id"])
    # texts meet their places once; posts of one user and id are put in the order of their texts
    both = posts.select("user_id", "id", F.struct("text").alias("_text"), F.lit(None).cast("long").alias("_at")).unionByName(
        placed.select("user_id", "id", F.lit(None).cast("struct<text:string>").alias("_text"), "_at"))
    lists = [F.sort_array(F.collect_list(c)).alias(c) for c in ("_text", "_at")]
    numbered = both.groupBy("user_id", "id").agg(*lists).select(
        "user_id", "id", F.explode(F.arrays_zip("_text", "_at")).alias("_one"))
    part = F.floor(F.col("_one._at") / chunk).alias("part")
    pairs = F.sort_array(F.collect_list(F.struct("id", F.col("_one._text.text").alias("text"))))
    return numbered.groupBy("user_id", part).agg(pairs.alias("_p")).select(
        "user_id", "part", F.transform("_p", lambda p: p["text"]).alias("texts")
    )


def interaction_counts(posts: DataFrame, layer: str) -> DataFrame:
    """How often each post was repeated, quoted or answered."""
    post, user = LAYERS[layer]
    return posts.where(F.col(post) > 0).groupBy(post, user).agg(F.count(F.lit(1)).alias("frequency"))


def interaction_edges(posts: DataFrame, layer: str, by: Sequence[str] = ()) -> DataFrame:
    """Directed edges from a user to the user they repeated, quoted or answered."""
    user = LAYERS[layer][1]
    return (
        posts.where(F.col(user) > 0)
        .groupBy(*by, F.col("user_id").alias("src"), F.col(user).alias("dst"))
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def user_domains(posts: DataFrame, urls: Column, by: Sequence[str] = ("user_id",)) -> DataFrame:
    """Shared link domains of each user; shorteners are left out."""
    links = posts.select(*by, F.explode(urls).alias("url")).select(*by, U.domain(F.col("url")).alias("domain"))
    return links.where(~U.is_discarded(F.col("domain"))).groupBy(*by, "domain").agg(
        F.count(F.lit(1)).alias("frequency")
    )


def _made(layer: str) -> Column:
    return F.col(LAYERS[layer][1]) != 0


def activity_counts(posts: DataFrame, by: Sequence[str] = ("user_id",)) -> DataFrame:
    """Posts made by each user, by kind; posts of no other kind are plain."""
    return posts.groupBy(*by).agg(
        F.count_if(F.col("id") != 0).alias("statuses_count"),
        F.count_if(_made("retweet")).alias("rts_count"),
        F.count_if(_made("quote")).alias("quotes_count"),
        F.count_if(_made("reply")).alias("replies_count"),
        F.count_if(~_made("retweet") & ~_made("quote") & ~_made("reply")).alias("plain_count"),
    )


def received_counts(posts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Reactions each user received, by kind, in one pass and one exchange."""
    reaction = F.explode(
        F.array(*[F.struct(F.lit(layer).alias("layer"), F.col(user).alias("user_id"))
                  for layer, (_, user) in LAYERS.items()])
    )
    rows = posts.select(*by, reaction.alias("r")).select(*by, "r.*").where(F.col("user_id") > 0)
    return rows.groupBy(*by, "user_id").agg(
        F.count_if(F.col("layer") == "retweet").alias("rts_received"),
        F.count_if(F.col("layer") == "quote").alias("quotes_received"),
        F.count_if(F.col("layer") == "reply").alias("replies_received"),
    )


def user_daily_stats(posts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per user and day: posts made, reactions received, profile counters.

    Each post becomes one row for its author and one for each account it
    reacts to, so both sides are counted in one pass and one exchange.
    """
    unique = posts.select("id", "date", "user_id", *[u for _, u in LAYERS.values()]).dropDuplicates(["id"])
    plain = ~_made("retweet") & ~_made("quote") & ~_made("reply")
    author = F.struct(F.lit("author").alias("role"), "user_id", *[_made(k).alias(k) for k in LAYERS], plain.alias("plain"))
    targets = [
        F.struct(F.lit(layer).alias("role"), F.col(user).alias("user_id"),
                 *[F.lit(False).alias(k) for k in (*LAYERS, "plain")])
        for layer, (_, user) in LAYERS.items()
    ]
    rows = unique.select("date", F.explode(F.array(author, *targets)).alias("r")).select("date", "r.*")
    counts = rows.where(F.col("user_id") > 0).groupBy("user_id", "date").agg(
        F.count_if(F.col("role") == "author").alias("statuses_count"),
        F.count_if(F.col("retweet")).alias("rts_count"),
        F.count_if(F.col("quote")).alias("quotes_count"),
        F.count_if(F.col("reply")).alias("replies_count"),
        F.count_if(F.col("plain")).alias("plain_count"),
        F.count_if(F.col("role") == "retweet").alias("rts_received"),
        F.count_if(F.col("role") == "quote").alias("quotes_received"),
        F.count_if(F.col("role") == "reply").alias("replies_received"),
    )
    counters = profiles.select("user_id", "date", "followers_count", "friends_count",
                               F.col("statuses_count").alias("profile_statuses_count"))
    return counts.where(F.col("statuses_count") > 0).join(counters, ["user_id", "date"])


def distinct_counts(df: DataFrame, **columns: str) -> DataFrame:
    """Number of rows and of distinct values of some columns."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.countDistinct(c).alias(name) for name, c in columns.items()]
    )
