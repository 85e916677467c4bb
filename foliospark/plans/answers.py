"""Typed rows from what a model returns, with a quarantine for what doesn't hold, asked again a bounded number of times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import reasoner
from ..durable import settled
from ..functions.text import repaired_json

#: Fields of a semantic unit, and those that must be there.
UNIT_FIELDS = {"title": "string", "start_paragraph": "int", "end_paragraph": "int", "semantic_type": "string", "summary": "string"}
UNIT_REQUIRED = ("title", "start_paragraph", "end_paragraph", "semantic_type")


def _fault(item: Column, fields: dict[str, str], required: tuple[str, ...]) -> Column:
    """What is wrong with an item, null if nothing."""
    faults = []
    for name, kind in fields.items():
        there = F.coalesce(F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant")) != "VOID", F.lit(False))
        value = F.try_variant_get(item, f"$.{name}", kind)
        if name in required:
            faults.append(F.when(~there, f"{name} is missing"))
        faults.append(F.when(there & value.isNull(), f"{name} is no {kind}"))
    told = F.array_compact(F.array(*faults))
    object_ = F.startswith(F.schema_of_variant(item), F.lit("OBJECT"))
    return F.when(item.isNull() | ~object_, "no object").otherwise(F.nullif(F.array_join(told, "; "), F.lit("")))


def checked(responses: DataFrame, under: str, fields: dict[str, str], required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Good items and faults of responses (key columns and `response`): (..., pos, *fields) and (..., pos, reason, raw).

    Each item of the list named `under` is in exactly one of the two; a response without such a list is one fault with a null pos. Fields that
    aren't required may be absent or null, but not of another type.
    """
    keys = [c for c in responses.columns if c != "response"]
    rows = responses.withColumn("v_", F.try_parse_json(repaired_json(F.col("response"))))
    rows = rows.withColumn("list_", F.try_variant_get("v_", f"$.{under}", "array<variant>"))
    reason = F.when(F.col("response").isNull(), "no response").when(F.col("v_").isNull(), "not JSON").when(F.col("list_").isNull(), f"no list {under}")
    whole = rows.withColumn("reason", reason).where("reason is not null").select(*keys, F.lit(None).cast("int").alias("pos"), "reason", F.col("response").alias("raw"))
    items = rows.where("list_ is not null").select(*keys, F.posexplode("list_").alias("pos", "item_")).withColumn("reason", _fault(F.col("item_"), fields, required))
    good = items.where("reason is null").select(*keys, "pos", *(F.try_variant_get("item_", f"$.{n}", k).alias(n) for n, k in fields.items()))
    bad = items.where("reason is not null").select(*keys, "pos", "reason", F.to_json("item_").alias("raw"))
    return good, whole.unionByName(bad)


def asked(prompts: DataFrame, call: Callable[[list[str]], list[str]], under: str, fields: dict[str, str], required: tuple[str, ...], attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Good items of all prompts, and the quarantine: (key columns, attempt, pos, *fields) and (key columns, attempt, pos, reason, raw, final).

    prompts: key columns and `prompt`. A response with a fault is asked again with the faults told, up to `attempts` times; the last response's good
    items count, its faults are final. A response without faults counts at once. No item is lost: each response's faults are in the quarantine.
    Prompts must differ in their key columns.
    """
    keys = [c for c in prompts.columns if c != "prompt"]
    todo, accepted, quarantine = prompts, [], []
    for attempt in range(1, attempts + 1):
        told = settled(reasoner.ask(todo, call))
        good, bad = checked(told.drop("prompt"), under, fields, required)
        bad = settled(bad)
        again = bad.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("reason")), ", ").alias("reasons_"))
        last = attempt == attempts or not bad.limit(1).count()
        same = [F.col(f"a_.{k}").eqNullSafe(F.col(f"b_.{k}")) for k in keys]
        whole = good if last else good.alias("a_").join(again.alias("b_"), same, "left_anti").select("a_.*")
        accepted.append(settled(whole.withColumn("attempt", F.lit(attempt))))
        quarantine.append(bad.withColumn("attempt", F.lit(attempt)).withColumn("final", F.lit(attempt == attempts)))
        if last:
            break
        more = F.concat("a_.prompt", F.lit("\n\nYour last answer did not hold: "), "b_.reasons_")
        todo = settled(told.drop("response").alias("a_").join(again.alias("b_"), same).select(*(F.col(f"a_.{k}").alias(k) for k in keys), more.alias("prompt")))
    out, held = accepted[0], quarantine[0]
    for a, q in zip(accepted[1:], quarantine[1:], strict=True):
        out, held = out.unionByName(a), held.unionByName(q)
    return out.select(*keys, "attempt", "pos", *fields), held.select(*keys, "attempt", "pos", "reason", "raw", "final")


def units(sections: DataFrame, call: Callable[[list[str]], list[str]], attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Semantic units of sections (doc_id, idx, prompt) by a model, and the quarantine."""
    return asked(sections.select("doc_id", "idx", "prompt"), call, "semantic_units", UNIT_FIELDS, UNIT_REQUIRED, attempts)
