"""Domain of a document by label or by keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns by domain, ties go to the domain that stands first.
PATTERNS = {
    "code": [r"\bdef\s+\w+\s*\(", r"\bclass\s+\w+[:\(]", r"\bfunction\s+\w+\s*\(", r"\bimport\s+\w+", r"\bfrom\s+\w+\s+import", r"#include\s*<", r"public\s+class\s+", r"=>", r"\{\s*\w+\s*:\s*"],
    "academic": [r"\babstract\b.*\bintroduction\b", r"\barXiv:\d{4}\.\d{4,6}", r"\bdoi:\s*10\.", r"\bet\s+al\.", r"\bcitation\b", r"\breferences?\b.*\[\d+\]", r"\btheorem\b.*\bproof\b", r"\bhypothesis\b"],
    "wikipedia": [r"\[\[.*?\]\]", r"==\s*.*?\s*==", r"\{\{cite", r"\bInfobox\b", r"Category:", r"\bmain article\b"],
    "news": [r"\b(WASHINGTON|LONDON|PARIS|BEIJING)\s*\(", r"\bAssociated Press\b", r"\bReuters\b", r"\breported\s+(today|yesterday)", r"\baccording to\b.*\bofficial", r"\bbreaking news\b"],
    "social": [r"\bu/\w+", r"\br/\w+", r"\bOP\s+(said|here)", r"\bupvote", r"\bkarma\b", r"@\w+\s+(tweeted|posted)"],
    "books": [r"\bChapter\s+\d+", r"\bPart\s+(I{1,3}|One|Two|Three)", r"\bCopyright\s+©", r"\bISBN[-\s]", r"\bPublished by\b"],
}
#: What the described rule looks at; sample=SAMPLE_CHARS does so.
SAMPLE_CHARS = 5000


def keyword_hits(c: Column, domain: str, sample: int | None = None) -> Column:
    head = F.coalesce(c, F.lit(""))
    head = head if sample is None else F.left(head, F.lit(sample))
    out = F.lit(0)
    for p in PATTERNS[domain]:
        out = out + F.regexp_like(head, F.lit("(?i)" + p)).cast("int")
    return out


def classify(df: DataFrame, text: str = "text", label: str | None = None, method: str = "hybrid", min_confidence: float | None = None, sample: int | None = None) -> DataFrame:
    """df with domain_found and domain_confidence.

    method is metadata, keyword or hybrid; a label column wins in metadata and hybrid where it is not
    null. The keyword rule looks at whole texts, with sample at that many first characters. min_confidence is
    accepted for compatibility and, as in the described pipeline, changes nothing.
    """
    if method not in ("metadata", "keyword", "hybrid"):
        raise ValueError(f"unknown method {method}")
    labelled = F.col(label).isNotNull() if label and method != "keyword" else F.lit(False)
    given = F.col(label) if label else F.lit(None).cast("string")
    if method == "metadata":
        return df.withColumn("domain_found", F.when(labelled, given).otherwise("common_crawl")).withColumn("domain_confidence", F.when(labelled, 1.0).otherwise(0.3))
    rows = df.withColumn("_hits", F.struct(*[keyword_hits(F.col(text), d, sample).alias(d) for d in PATTERNS]))
    hits = [F.col("_hits")[d] for d in PATTERNS]
    most = F.greatest(*hits)
    best = F.when(most == 0, "common_crawl")
    for d, h in zip(PATTERNS, hits):
        best = best.when(h == most, d)
    rows = rows.withColumn("domain_found", F.when(labelled, given).otherwise(best))
    rows = rows.withColumn("domain_confidence", F.when(labelled, 1.0).when(most == 0, 0.5).otherwise(F.least(most / 3.0, F.lit(1.0))))
    return rows.drop("_hits")


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)


def domain_counts(df: DataFrame, domain: str = "domain_found", text: str = "text") -> DataFrame:
    return df.groupBy(F.col(domain).alias("domain")).agg(F.count("*").alias("documents"), F.sum(token_estimate(F.col(text))).alias("tokens"))
