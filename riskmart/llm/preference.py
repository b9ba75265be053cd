"""Preference pairs for training: a shared prompt and two completions with loss masks.

The turns that the chosen and the rejected conversation open with alike are rendered once as
the prompt. What is left of either is its completion; its mask lists the stretches, in
characters, that a model is trained on, which are the assistant's words and their closing mark.
"""

from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def conversations(turns: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(id, turns): each conversation's (role, text) turns in order.

    Turns of one number are ordered by role and text; rows with a null id are left out, null
    turn numbers come first.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    ordered = F.array_sort(F.collect_list(turn))
    return turns.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def with_stale_answer(talks: DataFrame, turns_col="turns") -> DataFrame:
    """Adds chosen (the conversation) and rejected: its last answer replaced by the one before.

    Without an earlier answer the last one is left out; without any answer both are the same.
    """
    spots = F.filter(
        F.transform(turns_col, lambda t, i: F.when(t["role"] == TRAINED, i)), lambda i: i.isNotNull()
    )
    last, earlier = F.element_at("__spots", -1), F.get("__spots", F.size("__spots") - 2)
    answer = F.get(turns_col, F.col("__earlier"))["text"]
    rejected = (
        F.when(F.size("__spots") == 0, F.col(turns_col))
        .when(F.size("__spots") == 1, F.filter(turns_col, lambda t, i: i != F.get("__spots", F.lit(0))))
        .otherwise(
            F.transform(
                turns_col,
                lambda t, i: F.struct(t["role"].alias("role"), F.when(i == F.col("__last"), answer).otherwise(t["text"]).alias("text")),
            )
        )
    )
    spotted = talks.withColumn("__spots", spots)
    spotted = spotted.withColumn("__last", F.when(F.size("__spots") > 0, last)).withColumn("__earlier", earlier)
    return spotted.withColumn("rejected", rejected).withColumn("chosen", F.col(turns_col)).drop("__spots", "__last", "__earlier")


def _head(turn):
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(CLOSE))


def _body(turn):
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def _rendered(turns):
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _mask(turns):
    """(start, end) of the trained stretches of rendered turns."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state, turn):
        begin = state["at"] + F.length(_head(turn))
        end = begin + F.length(_body(turn))
        span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        spans = F.when(turn["role"] == TRAINED, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def format_preferences(pairs: DataFrame, chosen_col="chosen", rejected_col="rejected") -> DataFrame:
    """The rows with n_common, prompt, chosen_completion, rejected_completion and a mask for each.

    Turns are alike if role and text are, nulls included; a null conversation is an empty one
    and null roles and texts are rendered as empty. Every row stays: conversations that are
    alike throughout get empty completions. Columns of these names are replaced.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    kind = "array<struct<role:string,text:string>>"
    rows = pairs.withColumn("__c", F.coalesce(F.col(chosen_col).cast(kind), empty)).withColumn(
        "__r", F.coalesce(F.col(rejected_col).cast(kind), empty)
    )
    both = F.least(F.size("__c"), F.size("__r"))
    differs = F.zip_with(
        F.slice("__c", 1, F.col("__n")), F.slice("__r", 1, F.col("__n")), lambda a, b: ~a.eqNullSafe(b)
    )
    first = F.array_position(differs, True)
    rows = rows.withColumn("__n", both).withColumn(
        "n_common", F.when(first > 0, first - 1).otherwise(F.col("__n")).cast("int")
    )
    rest = {side: F.slice(side, F.col("n_common") + 1, F.size(side)) for side in ("__c", "__r")}
    rows = rows.withColumn("prompt", _rendered(F.slice("__c", 1, F.col("n_common"))))
    rows = rows.withColumn("__c", rest["__c"]).withColumn("__r", rest["__r"])
    return (
        rows.withColumn("chosen_completion", _rendered(F.col("__c")))
        .withColumn("rejected_completion", _rendered(F.col("__r")))
        .withColumn("chosen_mask", _mask(F.col("__c")))
        .withColumn("rejected_mask", _mask(F.col("__r")))
        .drop("__c", "__r", "__n")
    )
