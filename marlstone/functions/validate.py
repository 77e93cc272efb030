"""Checks of analysis results, as expressions: arrays of errors, empty if there are none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions import fixed


def _errors(*each: Column) -> Column:
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, r"\r\n|\r|\n", -1), lambda x: F.trim(x))


def missing_sections(summary: Column) -> Column:
    """Required headings that are no line of the summary, in their order."""
    return F.array_except(F.array(*[F.lit(s) for s in fixed.SUMMARY_SECTIONS]), _lines(summary))


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def result_errors(result: Column) -> Column:
    """What is wrong with the shape of a result given as JSON: summary a string; documents, if any, a list of objects with strings."""
    kind = lambda path: F.expr("null") if path is None else F.schema_of_variant(F.try_variant_get(F.try_parse_json(result), path, "variant"))
    named = lambda k: F.when(k.startswith("ARRAY"), "list").when(k.startswith("OBJECT"), "dict").when(k == "STRING", "str").when(k == "BOOLEAN", "bool").when(k == "BIGINT", "int").when(k.startswith("DECIMAL") | (k == "DOUBLE"), "float").otherwise("NoneType")
    whole, summary, documents = kind("$"), kind("$.summary"), kind("$.documents")
    is_object = F.coalesce(whole.startswith("OBJECT"), F.lit(False))
    items = F.from_json(F.get_json_object(result, "$.documents"), "array<string>")
    of_items = F.flatten(F.transform(items, _item_errors))
    top = F.when(~is_object, F.concat(F.lit("Expected finish(value) to receive a dict, got "), F.coalesce(named(whole), F.lit("str")), F.lit(".")))
    of_summary = F.when(is_object & summary.isNull(), "Missing required key 'summary'.").when(is_object & (summary != "STRING"), F.concat(F.lit("Expected 'summary' to be str, got "), named(summary), F.lit(".")))
    listed = F.coalesce(documents.startswith("ARRAY"), F.lit(False))
    of_documents = F.when(is_object & documents.isNotNull() & (documents != "VOID") & ~listed, F.concat(F.lit("Expected 'documents' to be list, got "), named(documents), F.lit(".")))
    return F.concat(_errors(top, of_summary, of_documents), F.when(is_object & listed, F.coalesce(of_items, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))


def _phase_errors(result: Column, of_summary: Callable[[Column], Column]) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(result), "$.summary", "variant"))
    shaped = F.coalesce(kind == "STRING", F.lit(False))
    error = F.when(~shaped, "Expected finish(value) to receive a dict with 'summary' key.").otherwise(of_summary(F.get_json_object(result, "$.summary")))
    return _errors(error)


def phase1_errors(result: Column) -> Column:
    """What is wrong with the result of phase 1 given as JSON."""
    return _phase_errors(result, lambda s: F.when(~s.contains("## Major directories"), "Expected 'summary' to include '## Major directories'."))


def phase2_errors(result: Column) -> Column:
    """What is wrong with the result of phase 2 given as JSON."""
    return _phase_errors(result, lambda s: F.when(~s.contains("## Relationships"), "Expected 'summary' to include '## Relationships'.").when(~s.contains("```mermaid"), "Expected 'summary' to include a Mermaid diagram (```mermaid)."))


def _item_errors(item: Column, at: Column) -> Column:
    where = F.concat(F.lit("Expected documents["), at.cast("string"), F.lit("]"))
    kind = lambda p: F.schema_of_variant(F.try_variant_get(F.try_parse_json(item), p, "variant"))
    whole = F.coalesce(kind("$"), F.lit("STRING"))
    named = lambda k: F.when(k.startswith("ARRAY"), "list").when(k.startswith("OBJECT"), "dict").when(k == "STRING", "str").when(k == "BOOLEAN", "bool").when(k == "BIGINT", "int").when(k == "VOID", "NoneType").otherwise("float")
    fields = [F.when(whole.startswith("OBJECT") & kind(f"$.{f}").isNotNull() & ~kind(f"$.{f}").isin("STRING", "VOID"), F.concat(where, F.lit(f"['{f}'] to be str, got "), named(kind(f"$.{f}")), F.lit("."))) for f in ("path", "title", "content")]
    return _errors(F.when(~whole.startswith("OBJECT"), F.concat(where, F.lit(" to be dict, got "), named(whole), F.lit("."))), *fields)


def finish_errors(summary: Column, contents: Column) -> Column:
    """What keeps a result from being final; ``contents``: those of its documents, null or empty if it has none."""
    text = F.regexp_replace(summary, r"^\s+|\s+$", "")
    low, absent = F.lower(text), missing_sections(text)
    relations = F.array_contains(_lines(text), "## Relationships")
    solid = F.exists(contents, lambda c: F.length(F.regexp_replace(c, r"^\s+|\s+$", "")) >= 40)
    return _errors(
        F.when(F.length(text) < 40, "Expected 'summary' to contain a substantive project analysis, got a very short summary."),
        F.when(F.size(absent) > 0, F.concat(F.lit("Expected 'summary' to include required Markdown sections: "), F.array_join(absent, ", "), F.lit("."))),
        F.when(relations & ~low.contains("```mermaid"), "Expected 'summary' Relationships section to include a Mermaid diagram (```mermaid)."),
        F.when(contains_any(low, fixed.SHALLOW_PHRASES), "Summary appears to describe an initial/root-only exploration. Continue inspecting important directories before finish()."),
        F.when(contains_any(low, fixed.FAILED_PHRASES), "Summary appears to contain child-query fallback, execution failure, or placeholder text. Regenerate a substantive project analysis before finish()."),
        F.when((F.size(contents) > 0) & ~F.coalesce(solid, F.lit(False)), "Expected at least one document with substantive 'content'."),
    )


def completed_summary(summary: Column) -> Column:
    """A summary of 40 characters or more, with a placeholder for each required section that it lacks."""
    absent = missing_sections(summary)
    added = F.array_join(F.transform(absent, lambda s: F.concat(s, F.lit("\n\n" + fixed.PLACEHOLDER))), "\n\n")
    lacks = (F.length(F.trim(summary)) >= 40) & (F.size(absent) > 0)
    return F.when(lacks, F.concat(F.regexp_replace(summary, r"\s+$", ""), F.lit("\n\n"), added)).otherwise(summary)


def normalised_result(result: Column) -> Column:
    """A result given as JSON, with a nested summary taken out and the required sections filled in; as JSON again.

    A summary that is an object with a text ``summary`` gives way to that text, and its list of documents becomes the result's if that
    has none. Other keys stay. What isn't an object, or no JSON, stays as it is; null stays null.
    """
    whole = F.try_parse_json(result)
    at = lambda path: F.try_variant_get(whole, path, "variant")
    is_ = lambda path, kind: F.coalesce(F.schema_of_variant(at(path)).startswith(kind), F.lit(False))
    text_of = lambda path: F.try_variant_get(whole, path, "string")
    nested = is_("$.summary", "OBJECT") & is_("$.summary.summary", "STRING")
    summary = F.when(nested, text_of("$.summary.summary")).when(is_("$.summary", "STRING"), text_of("$.summary"))
    keys = F.from_json(result, "map<string,variant>")
    lifted = nested & ~F.map_contains_key(keys, "documents") & is_("$.summary.documents", "ARRAY")
    one = lambda key, value: F.create_map(F.lit(key), value)
    none = F.create_map().cast("map<string,variant>")
    kept = F.map_filter(keys, lambda k, _: (k != "summary") | summary.isNull())
    new_summary = F.when(summary.isNotNull(), one("summary", F.variant_get(F.parse_json(F.to_json(F.array(completed_summary(summary)))), "$[0]", "variant"))).otherwise(none)
    documents = F.when(lifted, one("documents", at("$.summary.documents"))).otherwise(none)
    return F.when(is_("$", "OBJECT"), F.to_json(F.map_concat(kept, new_summary, documents))).otherwise(result)


def usable_markdown(markdown: Column) -> Column:
    """A worker's document: 120 characters, no code that ends a run, all sections."""
    low = F.lower(markdown)
    whole = F.lit(True)
    for s in fixed.WORKER_SECTIONS:
        whole = whole & markdown.contains(s)
    return (F.length(F.regexp_replace(markdown, r"^\s+|\s+$", "")) >= 120) & ~(low.contains("```python") & low.contains("finish(")) & whole


def weak(content: Column) -> Column:
    """A document under 40 characters, or with a mark of failure."""
    text = F.regexp_replace(content, r"^\s+|\s+$", "")
    return (F.length(text) < 40) | contains_any(F.lower(text), fixed.WEAK_MARKERS)
