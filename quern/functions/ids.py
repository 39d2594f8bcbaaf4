"""Stable, content-addressed identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hashed(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by colons; strings are literals."""
    return F.sha2(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def repo_id(repo: Column) -> Column:
    return hashed("repo", repo)


def module_id(repo: Column, path: Column) -> Column:
    return hashed("module", repo, path)


def file_id(repo: Column, path: Column) -> Column:
    return hashed("file", repo, path)


def symbol_id(repo: Column, path: Column, name: Column) -> Column:
    return hashed("symbol", repo, path, name)


def span_id(repo: Column, path: Column, name: Column, start: Column, end: Column) -> Column:
    return hashed("symbol", repo, path, F.concat(name, F.lit("@"), start.cast("string"), F.lit("-"), end.cast("string")))


def semantic_id(repo: Column, path: Column, start: Column, end: Column) -> Column:
    return hashed("semantic", repo, path, F.concat_ws("-", start.cast("string"), end.cast("string")))


def commit_id(repo: Column, commit: Column) -> Column:
    return hashed("commit", repo, F.substring(commit, 1, 12))


def edge_id(consumer_repo: Column, consumer: Column, provider_repo: Column, provider: Column) -> Column:
    """The arrow between the two ends is part of the key."""
    return F.sha2(F.concat(F.lit("edge:"), consumer_repo, F.lit(":"), consumer, F.lit("→"), provider_repo, F.lit(":"), provider), 256)


def annotation_id(target: Column, author: Column, created_at: Column) -> Column:
    return hashed("annotation", target, author, created_at)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def input_hash(summary: Column, readme: Column) -> Column:
    """Of the first thousand characters of both."""
    return F.substring(F.sha2(F.concat(F.substring(summary, 1, 1000), F.lit("|"), F.substring(readme, 1, 1000)), 256), 1, 16)
