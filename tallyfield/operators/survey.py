"""Species surveys: votes, followed-up questions, evenness, top species."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUBJECT = ["workflow_id", "subject_id"]
CHOICE = "array<struct<choice:string,answers:string>>"


def survey_votes(entries: DataFrame) -> DataFrame:
    """``workflow_id, subject_id, volunteer, species, answers`` (JSON text) for every choice of survey entries.

    A single choice in place of the array counts as its only element; nulls and other values give no row.
    """
    listed = F.when(F.ltrim("value").startswith("{"), F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("value"))
    return entries.select(*SUBJECT, "volunteer", F.explode(F.from_json(listed, CHOICE)).alias("c")).where("c.choice IS NOT NULL").select(
        *SUBJECT, "volunteer", F.col("c.choice").alias("species"), F.col("c.answers").alias("answers")
    )


def viewers(entries: DataFrame) -> DataFrame:
    """``workflow_id, subject_id, num_users, median_species``: volunteers with a survey entry, and the median number
    of non-empty entries among those who have one."""
    per_user = entries.where("value IS NOT NULL AND value <> '[[]]'").groupBy(*SUBJECT, "volunteer").agg(F.count_if(F.col("value") != "[]").alias("n"))
    return per_user.groupBy(*SUBJECT).agg(F.count(F.lit(1)).alias("num_users"), F.median(F.when(F.col("n") > 0, F.col("n"))).alias("median_species"))


def species_votes(votes: DataFrame) -> DataFrame:
    return votes.groupBy(*SUBJECT, "species").agg(F.count(F.lit(1)).alias("votes"))


def top_species(counts: DataFrame, seen: DataFrame) -> DataFrame:
    """The most voted species of each subject, as many as the median number per volunteer; ties by name."""
    rank = F.row_number().over(Window.partitionBy(*SUBJECT).orderBy(F.desc("votes"), "species"))
    ranked = counts.withColumn("rank", rank)  # one row for each species of the project in a subject
    return ranked.join(seen, SUBJECT).where(F.col("rank") <= F.floor("median_species")).select(
        *SUBJECT, "species", "votes", "rank", (F.col("votes") / F.col("num_users")).alias("share"), "num_users"
    )


def pielou(counts: DataFrame, seen: DataFrame) -> DataFrame:
    """Evenness of the species seen: entropy of votes over volunteers, over the log of the number of species; 0 for one."""
    p = F.col("votes") / F.col("num_users")
    h = counts.join(seen, SUBJECT).groupBy(*SUBJECT).agg((-F.sum(p * F.ln(p))).alias("h"), F.count(F.lit(1)).alias("num_species"))
    return h.select(*SUBJECT, "num_species", F.when(F.col("num_species") > 1, F.col("h") / F.ln("num_species")).otherwise(0.0).alias("pielou"))


def follow_up_votes(votes: DataFrame) -> DataFrame:
    """``workflow_id, subject_id, species, question, answer, votes``; each element of a list is a vote."""
    pairs = votes.select(*SUBJECT, "species", F.explode(F.from_json("answers", "map<string,string>")).alias("question", "said"))
    many = F.when(F.ltrim("said").startswith("["), F.from_json("said", "array<string>")).otherwise(F.array("said"))
    return pairs.select(*SUBJECT, "species", "question", F.explode(many).alias("answer")).where("answer IS NOT NULL").groupBy(
        *SUBJECT, "species", "question", "answer"
    ).agg(F.count(F.lit(1)).alias("votes"))


def report(votes: DataFrame, seen: DataFrame) -> DataFrame:
    """``workflow_id, subject_id, species, num_users, pielou, share, votes, answers`` of each subject's likeliest species.

    ``answers`` lists the counts of all follow-up answers as ``question=answer:votes``; null where nobody answered.
    """
    counts = species_votes(votes)
    said = follow_up_votes(votes).groupBy(*SUBJECT, "species").agg(  # answers that the project's questions have
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("question", "answer", "votes"))), lambda a: F.concat(a["question"], F.lit("="), a["answer"], F.lit(":"), a["votes"])), " ").alias("answers")
    )
    top = top_species(counts, seen).join(pielou(counts, seen).select(*SUBJECT, "pielou"), SUBJECT)
    return top.join(said, [*SUBJECT, "species"], "left").select(*SUBJECT, "species", "num_users", "pielou", "share", "votes", "answers")


def top_answer(follow_ups: DataFrame) -> DataFrame:
    """``workflow_id, subject_id, species, question, answer, share``: the likeliest answer (ties: the first by name) and its share of the answers."""
    top = follow_ups.groupBy(*SUBJECT, "species", "question").agg(F.min(F.struct((-F.col("votes")).alias("v"), "answer")).alias("t"), F.sum("votes").alias("all"))
    return top.select(*SUBJECT, "species", "question", "t.answer", (-F.col("t.v") / F.col("all")).alias("share"))


def how_many(follow_ups: DataFrame, order: DataFrame, question: str = "HWMN") -> DataFrame:
    """Lowest, likeliest (ties: the lower), its share, and highest answer to a question with ordered answers.

    ``order`` has ``workflow_id, answer, pos``; answers that a workflow doesn't list are left out.
    """
    rows = follow_ups.where(F.col("question") == question).join(order, ["workflow_id", "answer"])
    return rows.groupBy(*SUBJECT, "species").agg(
        F.min_by("answer", "pos").alias("lowest"), F.max_by("answer", F.struct("votes", -F.col("pos"))).alias("likeliest"),
        (F.max("votes") / F.sum("votes")).alias("share"), F.max_by("answer", "pos").alias("highest"),
    )
