"""Results of web tools as one union: search items, scraped pages, research jobs, errors. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts by which a tool says that it failed.
ERRORS = ["MCP error -32602", "execution failed:", "validation failed", "Invalid request body", "REDIRECT DETECTED", "error (400):", "error (404):", "error (429):", "error (500):"]
ITEM = "struct<url:string,title:string,snippet:string,position:int>"


def error_reason(text: Column) -> Column:
    """Why a result is an error, or null."""
    head = F.substring(text, 1, 400)
    out = F.when(F.coalesce(text, F.lit("")) == "", "empty").when(F.upper(F.substring(text, 1, 200)).contains("REDIRECT DETECTED"), "redirect_detected")
    for e in ERRORS:
        out = out.when(head.contains(e), e.rstrip(":").lower().replace(" ", "_"))
    return out


def persisted_path(text: Column) -> Column:
    """Where a too long result was saved, or null."""
    head = F.substring(text, 1, 500).rlike(r"(?i)<persisted-output>|Error: result \([\d,]+(?: characters)?[^)]*\)")
    path = F.regexp_extract(F.substring(text, 1, 2000), r"(?i)saved to:?\s*(/[^\s\"'<>]+\.(?:json|txt))", 1)
    return F.when(head & (path != ""), path)


def _numbered(items: Column) -> Column:
    return F.transform(items, lambda x, i: F.struct(x["url"].alias("url"), x["title"].alias("title"), x["snippet"].alias("snippet"), (i + 1).cast("int").alias("position")))


def _links(text: Column) -> Column:
    raw = F.from_json(F.regexp_extract(text, r"(?s)Links:\s*(\[.+?\])\s*(?:\n|$)", 1), "array<struct<url:string,title:string,snippet:string,description:string>>")
    return F.filter(_numbered(F.transform(raw, lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"), F.coalesce(x["snippet"], x["description"]).alias("snippet")))), lambda x: x["url"].isNotNull())


def _json_items(text: Column) -> Column:
    one = "array<struct<url:string,id:string,title:string,description:string,snippet:string,text:string>>"
    obj = F.from_json(text, f"web {one}, results {one}, data {one}")
    raw = F.coalesce(obj["web"], obj["results"], obj["data"], F.array().cast(one))
    shaped = F.transform(raw, lambda x: F.struct(F.coalesce(x["url"], x["id"]).alias("url"), x["title"].alias("title"), F.coalesce(x["description"], x["snippet"], F.substring(x["text"], 1, 500)).alias("snippet")))
    return F.filter(_numbered(shaped), lambda x: x["url"].isNotNull())


def _block_items(text: Column) -> Column:
    body = F.regexp_replace(text, r"(?s)^.*?(?=Title:)", "")
    field = lambda b, k: F.trim(F.regexp_extract(b, rf"(?sm)^{k}:\s*(.*?)(?=\n(?:Title|URL|Published|Author|Highlights?):|\z)", 1))
    shaped = F.transform(F.split(body, r"\n\s*\n(?=Title:\s)"), lambda b: F.struct(F.nullif(field(b, "URL"), F.lit("")).alias("url"), field(b, "Title").alias("title"), field(b, "Highlights?").alias("snippet")))
    return F.filter(_numbered(shaped), lambda x: x["url"].isNotNull())


def parse(results: DataFrame, ident: str = "result_id", tool: str = "tool_name", tool_input: str = "tool_input", text: str = "result_text") -> DataFrame:
    """id, kind (search, scrape, research_job_ref, error), query, url, title, content, items, research_id, reason.

    The parser is chosen by the tool's name. Texts of failing tools are errors with a reason, whatever the tool.
    """
    t, body = F.col(tool), F.coalesce(F.col(text), F.lit(""))
    name = F.lower(F.regexp_replace(F.coalesce(t, F.lit("")), r"^mcp__.*__", ""))
    reason = error_reason(F.col(text))
    start, check = name.contains("deep_researcher_start"), name.contains("deep_researcher_check")
    scrape = name.isin("webfetch", "firecrawl_scrape", "crawling_exa")
    job = F.from_json(F.trim(body), "success boolean, researchId string, model string, instructions string, status string, report string, output string")
    bad_job = F.when(job.isNull() | ~body.rlike(r"^\s*\{"), "non_json").when(start & (~F.coalesce(job["success"], F.lit(False)) | job["researchId"].isNull()), "no_research_id").when(check & ~(F.coalesce(job["status"], F.lit("")) == "completed"), F.concat(F.lit("status_"), F.coalesce(job["status"], F.lit("None"))))
    why = F.when(start | check, bad_job).otherwise(reason)
    kind = F.when(why.isNotNull(), "error").when(start, "research_job_ref").when(check | scrape, "scrape").otherwise("search")
    page = F.from_json(F.trim(body), "markdown string, content string, url string")
    boiled = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(page["markdown"], page["content"], body), r"(?m)^\s*\[Skip to content\]\([^)]+\)\s*", ""), r"(?is)You signed (?:in|out) with another tab.*?Dismiss alert", ""), r"(?i)\{\{\s*message\s*\}\}", ""), r"\n{3,}", "\n\n")
    head = F.substring(body, 1, 1000)
    url = F.when(check, F.concat(F.lit("exa://research/"), F.coalesce(job["researchId"], F.lit("")))).when(name == "crawling_exa", F.nullif(F.regexp_extract(head, r"(?m)^URL:\s*(https?://\S+)", 1), F.lit(""))).otherwise(F.coalesce(F.get_json_object(tool_input, "$.url"), page["url"]))
    items = F.when(name == "websearch", _links(body)).when(name.isin("firecrawl_search", "web_search_advanced_exa"), _json_items(body)).otherwise(_block_items(body))
    query = F.coalesce(F.get_json_object(tool_input, "$.query"), F.get_json_object(tool_input, "$.objective"))
    return results.select(
        F.col(ident), kind.alias("kind"), F.when(kind == "search", query).alias("query"), F.when(kind == "scrape", url).alias("url"),
        F.when((kind == "scrape") & (name == "crawling_exa"), F.nullif(F.regexp_extract(head, r"(?m)^#\s*(.+?)\s*$", 1), F.lit(""))).alias("title"),
        F.when(kind == "scrape", F.trim(F.when(check, F.coalesce(job["report"], job["output"], F.lit(""))).when(name == "firecrawl_scrape", boiled).otherwise(body))).when(kind == "research_job_ref", F.coalesce(job["instructions"], F.get_json_object(tool_input, "$.instructions"), F.lit(""))).alias("content"),
        F.when(kind == "search", F.coalesce(items, F.array().cast(f"array<{ITEM}>"))).alias("items"), F.when(kind == "research_job_ref", job["researchId"]).alias("research_id"), why.alias("reason"),
    )
