"""Calls of an external language model from Spark: batched, with two attempts, failures as rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import service
from ..operators.ranking import batches

#: A client takes a system and a user prompt and returns the answer's text; it is built once per task.
Client = Callable[[str, str], str]


def chat(prompts: DataFrame, make_client: Callable[[], Client], system: str, attempts: int = 2) -> DataFrame:
    """UX-02: ``id, answer, error`` for ``id, prompt``; an answer is the outermost JSON object, null after failures."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in parts:
            out = []
            for i, prompt in zip(pdf["id"], pdf["prompt"], strict=True):
                answer, error = None, None
                for _ in range(attempts):
                    try:
                        text = client(system, prompt)
                        answer = json.dumps(json.loads(text[text.index("{") : text.rindex("}") + 1]))
                        break
                    except Exception as e:  # noqa: BLE001  any failure of a call is a row
                        error = f"{type(e).__name__}: {e}"[:200]
                out.append((i, answer, None if answer else error))
            yield pd.DataFrame(out, columns=["id", "answer", "error"])

    return prompts.select("id", "prompt").mapInPandas(run, "id long, answer string, error string")


def judge_titles(titles: DataFrame, make_client: Callable[[], Client], system: str, size: int = 60) -> DataFrame:
    """UX-04: ``profile, title, fits`` in calls of so many titles; titles of a failed call stay undecided (no row)."""
    numbered = batches(titles.select("profile", "title").distinct(), ["profile"], [F.col("title")], size)
    calls = numbered.groupBy("profile", "batch").agg(F.array_sort(F.collect_list("title")).alias("titles"))
    calls = calls.withColumn("id", F.xxhash64("profile", "batch"))
    listed = F.array_join(F.transform("titles", lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")
    answers = chat(calls.select("id", listed.alias("prompt")), make_client, system).where("answer is not null")
    kept = F.from_json("answer", "fits array<string>")["fits"]
    rows = calls.join(answers, "id").select("profile", F.posexplode("titles").alias("i", "title"), kept.alias("fits"))
    return rows.select("profile", "title", F.array_contains(F.coalesce("fits", F.array()), (F.col("i") + 1).cast("string")).alias("fits"))


#: Characters of a posting's text that an assessment reads; companies of one call, and titles shown of each.
ASSESS_CHARS, COMPANIES_OF_A_CALL, TITLES_SHOWN = 9_000, 20, 3


def assess_prompt() -> Column:
    """UX-06: what a model reads of one posting, a line for each fact and the text behind."""
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    facts = {
        "TITLE": text("title"), "COMPANY": text("company"), "LOCATION": F.concat(text("location"), F.lit(" (remote flag: "), text("remote"), F.lit(")")), "EMPLOYMENT TYPE": text("employment_type"),
        "SOURCE": F.when(F.col("direct"), "employer ATS").otherwise(F.col("source")), "STATED SALARY": F.concat(text("salary_min"), F.lit("-"), text("salary_max"), F.lit(" "), text("currency")),
        "POSTED": F.date_format("posted", "yyyy-MM-dd"), "URL": text("url"),
    }
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v, F.lit(""))) for k, v in facts.items()]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\nDESCRIPTION:\n"), F.left(text("text"), F.lit(ASSESS_CHARS)))


def assess(postings: DataFrame, make_client: Callable[[], Client], system: str, schema: str) -> DataFrame:
    """UX-06: ``seq, assessment, error``: a model's answer on each posting in the caller's schema, one posting a call."""
    answers = chat(postings.select(F.col("seq").alias("id"), assess_prompt().alias("prompt")), make_client, system)
    return answers.select(F.col("id").alias("seq"), F.from_json("answer", schema).alias("assessment"), "error")


def company_lines(postings: DataFrame) -> DataFrame:
    """UX-05: ``profile, company_id, line`` of postings with ``profile``: a company's name, first titles and a snippet."""
    keyed = postings.withColumn("company_id", T.company_key(F.col("company"))).where("company_id <> ''")
    first = Window.partitionBy("profile", "company_id").orderBy("seq")
    few = keyed.withColumn("r", F.row_number().over(first)).where(F.col("r") <= TITLES_SHOWN)
    titles = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "title"))), lambda x: x["title"]))
    shown = few.groupBy("profile", "company_id").agg(titles.alias("titles"), F.min_by(F.struct("company", service.snippet(F.col("text")).alias("snippet")), "seq").alias("one"))
    return shown.select("profile", "company_id", F.concat("one.company", F.lit(" – hiring: "), F.array_join("titles", "; "), F.lit(" – "), "one.snippet").alias("line"))


def rate_companies(postings: DataFrame, make_client: Callable[[], Client], system: str, size: int = COMPANIES_OF_A_CALL) -> DataFrame:
    """UX-05: ``profile, company_id, fits`` in calls of so many companies; those of a failed call stay undecided (no row)."""
    numbered = batches(company_lines(postings), ["profile"], [F.col("company_id")], size)
    calls = numbered.groupBy("profile", "batch").agg(F.array_sort(F.collect_list(F.struct("company_id", "line"))).alias("rows"))
    listed = F.array_join(F.transform("rows", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["line"])), "\n")
    calls = calls.select(F.xxhash64("profile", "batch").alias("id"), "profile", "rows", listed.alias("prompt"))
    answers = chat(calls, make_client, system).where("answer is not null")
    fits = F.coalesce(F.from_json("answer", "fits array<string>")["fits"], F.array())
    rows = calls.join(answers, "id").select("profile", F.posexplode("rows").alias("i", "row"), fits.alias("fits"))
    return rows.select("profile", "row.company_id", F.array_contains("fits", (F.col("i") + 1).cast("string")).alias("fits"))


def derive_searches(texts: DataFrame, make_client: Callable[[], Client], system: str) -> DataFrame:
    """UX-07: ``id, derived, error`` of ``id, text``: a person's text as a search, by the schema that ``validate`` keeps."""
    answers = chat(texts.select("id", F.col("text").alias("prompt")), make_client, system)
    derived = service.validate(F.col("answer"))
    return answers.select("id", derived.alias("derived"), F.when(derived.isNull(), F.coalesce("error", F.lit("no usable answer"))).alias("error"))
