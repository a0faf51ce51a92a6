"""Recipes: lists of steps over a table of files, run step by step; rows that fail are set aside, not the job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.pii import find_pii
from leafmill.functions.ranges import bates_label
from leafmill.functions.spans import mask_spans
from leafmill.functions.text import decode_entities
from leafmill.operators.pages import prefix_sums, unique_names
from leafmill.operators.tables import cut


@dataclass
class Step:
    """``accepts``: kinds of files that it takes, others pass. ``one``: the new text and an error for each row, from its text. ``all``: for
    steps that see all rows at once, a function of the rows it takes. ``produces``: the kind of its results, where it changes. ``once``: a recipe
    has it once at most. ``seals``: no later step may change what it made. ``problem``: what is wrong with its settings."""

    name: str
    accepts: tuple[str, ...]
    one: Callable[[Column], tuple[Column, Column]] | None = None
    all: Callable[[DataFrame], DataFrame] | None = None
    produces: str | None = None
    once: bool = False
    seals: bool = False
    problem: str | None = None


def check_steps(steps: list[Step]) -> list[tuple[int, str]]:
    """The places of steps that cannot work, from 0, and why: bad settings, a second one of a kind that may stand once, or after a sealing step."""
    out: list[tuple[int, str]] = []
    sealed: Step | None = None
    for k, s in enumerate(steps):
        if sealed and set(s.accepts) & set(sealed.accepts):
            out.append((k, f"{s.name} would change what {sealed.name} sealed: move it before that step"))
        if s.once and any(t.name == s.name for t in steps[:k]):
            out.append((k, f"{s.name} can only be used once"))
        if s.problem:
            out.append((k, s.problem))
        sealed = sealed or (s if s.seals else None)
    return out


@dataclass
class Result:
    """``outputs``: rows that some step changed, under unique names; ``failures``: name, step and message; ``untouched``: the rest."""

    outputs: DataFrame
    failures: DataFrame
    untouched: DataFrame
    plan: list[str] = field(default_factory=list)


def plan_files(files: DataFrame, steps: list[Step]) -> DataFrame:
    """``touches``, the steps that will take each file, ``kind_after``, its kind at the end, and ``together_at``, the place of the first step that takes it with
    all others, from 0, or null."""
    kind, touched, together = F.col("kind"), F.array().cast("array<string>"), F.lit(None).cast("int")
    for k, s in enumerate(steps):
        takes = kind.isin(list(s.accepts))
        together = F.coalesce(together, F.when(takes & F.lit(s.all is not None), k))
        touched = F.when(takes, F.concat(touched, F.array(F.lit(s.name)))).otherwise(touched)
        kind = F.when(takes & F.lit(s.produces is not None), F.lit(s.produces)).otherwise(kind)
    return files.withColumns({"touches": touched, "kind_after": kind, "together_at": together})


def run_recipe(files: DataFrame, steps: list[Step]) -> Result:
    """Runs ``steps`` over ``tab_order, name, kind, text``.

    Steps that cannot work (``check_steps``) are an error before anything runs. A row that a step cannot take drops out with the step's name and a message; rows of other kinds pass. The steps are one
    pass over the files, with a shuffle only where one sees all rows. The outputs are written once, as giving them their names goes over them several times.
    """
    problems = check_steps(steps)
    if problems:
        raise ValueError("; ".join(f"step {k + 1}: {why}" for k, why in problems))
    df = files.withColumn("_touched", F.lit(False)).withColumn("_failed", F.lit(None).cast("struct<step:string,message:string>"))
    for s in steps:
        takes = F.col("_failed").isNull() & F.col("kind").isin(list(s.accepts))
        if s.all is not None:
            taken, rest = df.filter(takes), df.filter(~takes)
            made = s.all(taken.select(*files.columns)).withColumn("_touched", F.lit(True)).withColumn("_failed", F.lit(None).cast("struct<step:string,message:string>"))
            df = rest.unionByName(made)
        else:
            text, error = s.one(F.col("text"))
            # made by a generator, so that what later steps and filters ask of the new text does not make it again
            df = df.select("*", F.inline(F.array(F.struct(F.when(takes, text).alias("_text"), F.when(takes, error).alias("_error")))))
            good = takes & F.col("_error").isNull()
            df = df.withColumns({
                "_failed": F.when(takes & F.col("_error").isNotNull(), F.struct(F.lit(s.name).alias("step"), F.col("_error").alias("message"))).otherwise(F.col("_failed")),
                "text": F.when(good, F.col("_text")).otherwise(F.col("text")),
                "_touched": F.col("_touched") | good,
                "kind": F.when(good & F.lit(s.produces is not None), F.lit(s.produces)).otherwise(F.col("kind")),
            }).drop("_text", "_error")
    failures = df.filter("_failed is not null").select("name", "_failed.step", "_failed.message")
    alive = df.filter("_failed is null")
    outputs = unique_names(cut(alive.filter("_touched").drop("_touched", "_failed")))
    return Result(outputs, failures, alive.filter("not _touched").drop("_touched", "_failed"), [s.name for s in steps])


def redact_step(kinds: list[str] | None = None) -> Step:
    return Step("redact", ("text",), one=lambda t: (mask_spans(t, find_pii(t, kinds)), F.when(t.isNull(), "no text")))


def require_text_step(least: int = 1) -> Step:
    return Step("check", ("text",), one=lambda t: (t, F.when(F.coalesce(F.length(t), F.lit(0)) < least, F.lit(f"fewer than {least} characters"))))


def bates_step(prefix: str = "", digits: int = 6) -> Step:
    """A number for each file, in tab order, before its text."""

    def number(df: DataFrame) -> DataFrame:
        at = prefix_sums(df.withColumn("_one", F.lit(1)), "tab_order", "_one", "_at").drop("_one")
        return at.withColumn("text", F.concat(bates_label(F.col("_at") + 1, prefix, "", digits), F.lit(" "), F.coalesce("text", F.lit("")))).drop("_at")

    problem = None if 1 <= digits <= 12 else "use between 1 and 12 digits"
    return Step("number", ("text",), all=number, once=True, problem=problem)


def stamp_step(text: str) -> Step:
    """A line before each text."""
    return Step("stamp", ("text",), one=lambda t: (F.concat(F.lit(f"{text}\n"), F.coalesce(t, F.lit(""))), F.lit(None).cast("string")), problem=None if text.strip() else "type the text of the stamp")


def clean_step() -> Step:
    """White space as single spaces, no control characters, entities as characters."""
    tidy = lambda t: F.trim(F.regexp_replace(F.regexp_replace(decode_entities(t), "[\\x00-\\x08\\x0e-\\x1f]", ""), "[ \t]+", " "))
    return Step("clean", ("text",), one=lambda t: (tidy(t), F.when(t.isNull(), "no text")))


def seal_step() -> Step:
    """A last line with the SHA-256 of what stands before it; nothing may change the text after that."""
    return Step("seal", ("text",), one=lambda t: (F.concat(t, F.lit("\nsha256:"), F.sha2(t, 256)), F.when(t.isNull(), "no text")), once=True, seals=True)


#: Ready recipes.
PRESETS = {
    "share safely": [require_text_step(), redact_step()],
    "numbered bundle": [require_text_step(), bates_step("LM-")],
    "draft copies": [stamp_step("DRAFT"), bates_step("")],
    "readable scans": [clean_step(), require_text_step(2)],
    "sealed originals": [clean_step(), redact_step(), seal_step()],
}
