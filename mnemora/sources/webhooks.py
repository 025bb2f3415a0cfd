"""Repository webhooks become session memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USER = "user:struct<login:string>"
PAYLOAD = (
    "repository struct<full_name:string>, "
    "commits array<struct<id:string,message:string,author:struct<name:string>,added:array<string>,modified:array<string>>>, "
    f"issue struct<number:bigint,title:string,body:string,{USER}>, comment struct<body:string,{USER}>, "
    f"pull_request struct<number:bigint,title:string,body:string,{USER},head:struct<ref:string>,base:struct<ref:string>>, "
    f"review struct<body:string,state:string,{USER}>"
)

# File extension -> language of changed files.
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "ts": "typescript", "mts": "typescript", "go": "go"}


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def language_of(name: Column, languages: dict[str, str]) -> Column:
    ext = extension(name)
    chain = None
    for key, value in languages.items():
        chain = F.when(ext == key, value) if chain is None else chain.when(ext == key, value)
    return chain


def webhooks_to_memories(payloads: DataFrame, tenant_id: str | None = None) -> DataFrame:
    """(event_id, kind, content, category, tags, source). ``payloads``: event_id, event_type, payload (JSON text).

    A push gives one memory per commit and one per changed file of a known language; issues, comments, pull requests
    and reviews give one each, reviews without text none. All parts of a payload come from one pass over the rows, so
    the operator works on streams as well.
    """
    rows = payloads.select("event_id", "event_type", F.from_json("payload", PAYLOAD).alias("p")).withColumn(
        "repo", F.coalesce("p.repository.full_name", F.lit("unknown")))
    word = lambda column, default: F.coalesce(column, F.lit(default))

    def entry(kind: str, category: str, content: Column, *tags: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), content.alias("content"), F.lit(category).alias("category"),
            F.array(F.concat(F.lit("repo:"), "repo"), F.lit(f"github:{kind}"), *tags).alias("tags"))

    def tag(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix), value.cast("string"))

    def of_commit(c: Column) -> Column:
        files = F.concat(F.coalesce(c["added"], F.array().cast("array<string>")), F.coalesce(c["modified"], F.array().cast("array<string>")))
        commit = word(c["id"], "unknown")
        short = F.substring(commit, 1, 8)
        whole = entry("push", "events", F.concat(
            F.lit("Commit "), short, F.lit(" by "), word(c["author"]["name"], "unknown"), F.lit(": "), word(c["message"], ""),
            F.lit("\nChanged files: "), F.array_join(files, ", ")), tag("commit:", short))
        known = F.filter(files, lambda f: language_of(f, LANGUAGES).isNotNull())
        changed = F.transform(known, lambda f: entry(
            "file_change", "entities", F.concat(F.lit("[File changed: "), f, F.lit(" in commit "), commit, F.lit("]")),
            tag("language:", language_of(f, LANGUAGES)), tag("file:", f)))
        return F.array_append(changed, whole)

    issue, comment, pull, review = F.col("p.issue"), F.col("p.comment"), F.col("p.pull_request"), F.col("p.review")
    issue_no, pull_no = word(issue["number"], 0), word(pull["number"], 0)
    of_issue = F.when(issue.isNotNull(), entry("issue", "events", F.concat(
        F.lit("Issue #"), issue_no.cast("string"), F.lit(": "), word(issue["title"], "Untitled"), F.lit("\nBy: "),
        word(issue["user"]["login"], "unknown"), F.lit("\n\n"), word(issue["body"], "")), tag("issue:", issue_no)))
    of_comment = F.when(comment.isNotNull(), entry("issue_comment", "events", F.concat(
        F.lit("Comment on issue #"), issue_no.cast("string"), F.lit(" by "), word(comment["user"]["login"], "unknown"), F.lit(":\n"),
        word(comment["body"], "")), tag("issue:", issue_no)))
    of_pull = F.when(pull.isNotNull(), entry("pull_request", "events", F.concat(
        F.lit("PR #"), pull_no.cast("string"), F.lit(": "), word(pull["title"], "Untitled"), F.lit("\nBy: "),
        word(pull["user"]["login"], "unknown"), F.lit("\nBranch: "), word(pull["head"]["ref"], ""), F.lit(" → "),
        word(pull["base"]["ref"], ""), F.lit("\n\n"), word(pull["body"], "")), tag("pr:", pull_no)))
    of_review = F.when(review.isNotNull() & (word(review["body"], "") != ""), entry("review", "events", F.concat(
        F.lit("Review on PR #"), pull_no.cast("string"), F.lit(" by "), word(review["user"]["login"], "unknown"), F.lit(" ("),
        word(review["state"], "unknown"), F.lit("):\n"), review["body"]), tag("pr:", pull_no)))
    found = (
        F.when(F.col("event_type") == "push", F.flatten(F.transform("p.commits", of_commit)))
        .when(F.col("event_type").isin("issues", "issue_comment"), F.array_compact(F.array(of_issue, of_comment)))
        .when(F.col("event_type").isin("pull_request", "pull_request_review"), F.array_compact(F.array(of_pull, of_review)))
    )
    return rows.select("event_id", "repo", F.inline(found)).select(
        "event_id", "kind", "content", "category", "tags", F.concat(F.lit("github:"), "repo").alias("source"))
