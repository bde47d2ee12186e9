"""Answers as text lines: a projection of finished turns, after their traces are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark import schema as s
from foliospark.functions import text as t
from foliospark.operators.verify import looked_up

# What is shown where there is nothing to show.
REFUSAL = "I can't source this adequately."
SILENCE = "The sources in scope are silent on this question."
NO_ANSWER = "I couldn't produce an answer for this question."

_LINES = "array<string>"


def render_answers(turns: DataFrame, sources: DataFrame, key: str = "request_id") -> DataFrame:
    """key, line_no, line of turns (key, outcome, answer); ``sources``: corpus_id, tier, work, edition, label, a row for each corpus.

    Slots come in their order, quotes whole. A degraded turn shows the refusal and its confidence, a failed
    generation one line, a silent answer its reason.
    """
    turns = looked_up(turns, sources.select("corpus_id", "tier", "work", "edition", "label"), key, "facts")
    of = lambda c, corpus: F.trim(F.coalesce(F.element_at(F.col("facts"), corpus)[c], F.lit("")))
    a = F.col("answer")
    none = F.array().cast(_LINES)
    given = lambda cond, *lines: F.when(cond, F.array(*lines)).otherwise(none)
    pad = "     "

    def cited(c: Column) -> Column:
        tier = F.coalesce(F.nullif(of("tier", c["corpus_id"]), F.lit("")), F.lit("unspecified"))
        work, edition, label = (of(k, c["corpus_id"]) for k in ("work", "edition", "label"))
        named = F.when(edition == "", work).otherwise(F.concat(work, F.lit(" ("), edition, F.lit(")")))
        return F.concat(
            F.array(F.concat(F.lit(f"{pad}["), tier, F.lit("] "), c["corpus_id"], F.lit(" "), c["locator"])), given(work != "", F.concat(F.lit(f"{pad}  "), named)),
            given(label != "", F.concat(F.lit(f"{pad}  "), tier, F.lit(": "), label)), F.array(F.concat(F.lit(f'{pad}  "'), t.trim_space(c["quote"]), F.lit('"'))),
        )

    citations = lambda x: F.flatten(F.transform(F.coalesce(x, F.array().cast(f"array<{s.CITATION.simpleString()}>")), cited))

    def slot(name: str, title: str, head: str, tail) -> Column:
        items = F.coalesce(a[name], F.array().cast(s.ANSWER[name].dataType.simpleString()))
        block = lambda x, i: F.concat(F.array(F.concat(F.lpad((i + 1).cast("string"), 3, " "), F.lit(". "), F.coalesce(x[head], F.lit("")))), tail(x), citations(x["citations"]))
        return F.when(F.size(items) > 0, F.concat(F.array(F.lit(title)), F.flatten(F.transform(items, block)), F.array(F.lit("")))).otherwise(none)

    text = lambda field: lambda x: given(~t.is_blank(x[field]), F.concat(F.lit(pad), t.trim_space(x[field])))
    held = lambda x: given(F.coalesce(F.size(x["held_by"]), F.lit(0)) > 0, F.concat(F.lit(f"{pad}held by: "), F.array_join(x["held_by"], ", ")))
    contested = a["contested"]
    sure = F.array(F.lit("confidence"), F.concat(F.lit("  "), F.coalesce(a["confidence"]["level"], F.lit("unspecified")), F.lit(" — "), F.coalesce(a["confidence"]["reason"], F.lit(""))))
    whole = F.concat(
        given(~t.is_blank(a["position"]), F.lit("position"), F.concat(F.lit("  "), t.trim_space(a["position"])), F.lit("")),
        slot("arguments", "arguments", "claim", text("warrant")), slot("descriptions", "descriptions", "subject", text("content")), slot("contrary_positions", "contrary positions", "position", held),
        F.when(F.coalesce(contested["is_contested"], F.lit(False)), F.concat(
            F.array(F.concat(F.lit("contested: "), contested["locus"])), given(~t.is_blank(contested["state_of_debate"]), F.concat(F.lit("  "), t.trim_space(contested["state_of_debate"]))), citations(contested["citations"]), F.array(F.lit("")))).otherwise(none),
        sure,
    )
    lines = F.when(F.col("outcome") == "generation-failed", F.array(F.lit(NO_ANSWER))).when(F.col("outcome") == "degraded", F.concat(F.array(F.lit(REFUSAL), F.lit("")), sure))
    lines = lines.when(~t.is_blank(a["no_answer_reason"]), F.concat(F.array(F.lit(SILENCE), F.concat(F.lit("  "), t.trim_space(a["no_answer_reason"])), F.lit("")), sure)).otherwise(whole)
    return turns.select(key, F.posexplode(lines).alias("line_no", "line"))


#: Fixed value: depth of a search where none is set.
DEFAULT_TOP_K = 20


def top_k(setting: str | None) -> int:
    """A search depth from a setting's text; what is no depth is an error."""
    text = (setting or "").strip()
    if not text:
        return DEFAULT_TOP_K
    value = int(text)
    if not 0 < value <= 2**31 - 1:
        raise ValueError(f"top_k {value} is no search depth")
    return value
