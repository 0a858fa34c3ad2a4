"""Packages of context under one budget of tokens: files, symbols, flow and tests in this order, then snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators.retrieve import Index, Retrieval
from quarrystone.session import shuffled, staged

SECTIONS = ("files", "symbols", "flow", "tests", "snippets")
NO_REASON = "related by code graph retrieval"


def admit_in_sections(rows: DataFrame, group: str, budget: Column, sections: tuple[str, ...] = SECTIONS, skipping: tuple[str, ...] = ("snippets",), most: int = 64) -> DataFrame:
    """Rows of ``(group, section, ord, cost, …)`` that fit, with ``spent``, the sum so far over all sections of the group.

    A section is taken in order up to the first row that doesn't fit, and the next one goes on with what is left. In a
    ``skipping`` section rows that don't fit are passed over; it is a short list, of which the first ``most`` rows of a
    group count. Costs are positive; a null cost never fits. Groups without rows have none. What each section admits is
    staged, as all later ones depend on it.
    """
    rows = staged(rows, "candidates")
    taken = None
    for section in sections:
        mine = rows.where(F.col("section") == section)
        spent_so_far = None if taken is None else taken.groupBy(group).agg(F.max("spent").alias("used"))
        mine = mine.withColumn("used", F.lit(0).cast("long")) if spent_so_far is None else mine.join(spent_so_far, group, "left").withColumn("used", F.coalesce("used", F.lit(0).cast("long")))
        if section in skipping:
            items = F.slice(F.sort_array(F.collect_list(F.struct("ord", F.col("cost").cast("long").alias("cost")))), 1, most)
            start = F.struct(F.first("used").alias("used"), F.array().cast("array<struct<ord:bigint,spent:bigint>>").alias("kept"))

            def step(acc: Column, x: Column) -> Column:
                spent = acc["used"] + x["cost"]
                fits = F.coalesce(spent <= budget, F.lit(False))
                return F.struct(F.when(fits, spent).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(F.struct(x["ord"].cast("long").alias("ord"), spent.alias("spent"))))).otherwise(acc["kept"]).alias("kept"))

            folded = mine.groupBy(group).agg(items.alias("items"), start.alias("start")).select(group, F.aggregate("items", F.col("start"), step)["kept"].alias("kept"))
            fits = mine.join(folded.select(group, F.explode("kept").alias("k")).select(group, F.col("k.ord").alias("ord"), F.col("k.spent").alias("spent")), [group, "ord"])
        else:
            window = Window.partitionBy(group).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
            fits = mine.withColumn("spent", F.col("used") + F.sum("cost").over(window)).withColumn("full", F.max(F.col("cost").isNull() | (F.col("spent") > budget)).over(window)).where(~F.col("full"))
        fits = staged(fits.select(*rows.columns, F.col("spent").cast("long").alias("spent")), "section")
        taken = fits if taken is None else taken.unionByName(fits)
    return taken


def confidence(top_score: Column, files: Column, symbols: Column, task_type: Column, has_diff: Column, failed: Column | None = None) -> Column:
    """``low``, ``medium`` or ``high``, from the best file's score and what was found. A review or impact question about
    changes at hand needs a lower score."""
    score = F.coalesce(top_score, F.lit(0))
    changes = task_type.isin("code_review", "impact_analysis") & has_diff
    return F.when((files == 0) if failed is None else failed | (files == 0), "low").when((changes & (score >= 40)) | ((score >= 50) & (symbols >= 1)), "high").when((score >= 20) | (files >= 2), "medium").otherwise("low")


def reason_text(reasons: Column) -> Column:
    return F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise(NO_REASON)


def merged_reasons(rows: DataFrame, key: str = "path") -> DataFrame:
    """``(key, score, reasons)`` of ``(key, ord, score, reasons)``: the sum of scores, and the different reasons in the order
    of the rows that gave them."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "reasons"))), lambda x: F.coalesce(x["reasons"], F.array().cast("array<string>")))
    return rows.groupBy(key).agg(F.sum("score").alias("score"), F.array_distinct(F.flatten(ordered)).alias("reasons"))


def flow_lines(selected: DataFrame, edges: DataFrame, order: str = "ord") -> DataFrame:
    """``(ord, item)``: "a -> b" for edges with both ends selected, in the order of the selected files."""
    chosen = selected.select("path", order)
    inside = edges.select("src", "dst").distinct().join(shuffled(chosen.select(F.col("path").alias("src"), F.col(order).alias("a"))), "src").join(shuffled(chosen.select(F.col("path").alias("dst"), F.col(order).alias("b"))), "dst")
    return inside.select((F.col("a") * F.lit(1_000_000) + F.col("b")).cast("long").alias("ord"), F.concat("src", F.lit(" -> "), "dst").alias("item"))


def snippet(text: Column, start: Column, end: Column, most: int = 40) -> Column:
    """The lines of a symbol, null if there are more than ``most``."""
    count = end - start + 1
    return F.when((count >= 1) & (count <= most), F.array_join(F.slice(T.lines(text), start, count), "\n"))


def context_items(index: Index, found: Retrieval, task_type: str, diff: str = "") -> DataFrame:
    """``(section, ord, item, cost)`` of all that could go into a package, as JSON or plain text, before any budget."""
    rank = F.row_number().over
    files = found.files.withColumn("ord", rank(Window.orderBy(F.desc("score"), "path")).cast("long"))  # a top list
    symbols = found.symbols.withColumn("ord", rank(Window.orderBy(F.desc("score"), "name", "path", "id")).cast("long"))
    known = index.symbols.dropDuplicates(["id"]).select("id", "type", "parent_name", "start_line", "end_line", "signature")
    named = symbols.join(known, "id").withColumn("full", F.concat_ws(".", "parent_name", "name"))
    flow = flow_lines(files, index.edges).orderBy("ord").limit(18 if task_type in ("explain_flow", "impact_analysis") else 10)
    tests = found.tests.withColumn("ord", F.dense_rank().over(Window.orderBy("path")).cast("long")).distinct() if found.tests.columns == ["path"] else found.tests
    texts = index.files.select("path", "text") if "text" in index.files.columns else index.files.select("path", F.lit(None).cast("string").alias("text"))
    shown = named.where(F.col("ord") <= (2 if task_type == "explain_flow" else 3)).join(texts, "path", "left")
    code = F.coalesce(snippet(F.col("text"), F.col("start_line"), F.col("end_line")), F.col("signature"))
    parts = [
        files.select(F.lit("files").alias("section"), "ord", F.to_json(F.struct("path", F.lit(NO_REASON).alias("reason"), T.half_up(F.col("score")).alias("score"))).alias("item")),
        named.select(F.lit("symbols"), "ord", F.to_json(F.struct(F.col("full").alias("name"), F.col("type").alias("kind"), F.col("path").alias("filePath"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), F.lit(NO_REASON).alias("reason")))),
        flow.select(F.lit("flow"), "ord", "item"),
        tests.select(F.lit("tests"), "ord", F.col("path")),
        shown.where(F.length(F.trim(code)) > 0).select(F.lit("snippets"), "ord", F.to_json(F.struct(F.col("path").alias("filePath"), F.col("full").alias("symbolName"), code.alias("code")))),
    ]
    if diff.strip() and task_type in ("code_review", "impact_analysis"):
        one = index.files.sparkSession.range(1)
        parts.append(one.select(F.lit("snippets"), F.lit(0).cast("long"), F.to_json(F.struct(F.lit("git diff").alias("filePath"), F.lit("current changes").alias("symbolName"), F.lit(diff).alias("code")))))
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    return every.withColumn("cost", T.token_estimate(F.col("item")))


def context_package(index: Index, found: Retrieval, task_type: str, tokens: int, diff: str = "") -> DataFrame:
    """``(section, ord, item, cost, spent)`` of one task's package."""
    rows = context_items(index, found, task_type, diff).withColumn("task", F.lit(0))
    return admit_in_sections(rows, "task", F.lit(tokens)).drop("task")


def markdown(package: DataFrame, task: str) -> str:
    """A package as text. It holds no more than the budget, so it may come to the driver."""
    rows = package.orderBy(F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")), "ord").collect()
    lines = [f"# {task}", ""]
    for section in SECTIONS:
        mine = [r["item"] for r in rows if r["section"] == section]
        if mine:
            lines += [f"## {section.title()}", "", *(f"- {x}" for x in mine), ""]
    return "\n".join(lines)
