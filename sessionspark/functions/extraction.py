"""Facts of a resume text, as column expressions without Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keywords import matching

# Keywords, patterns and host rules of the data model.
TECH_SKILLS = [
    "python", "java", "javascript", "typescript", "c++", "c#", "go", "rust", "ruby", "php", "swift", "kotlin", "scala", "r", "matlab", "sql", "nosql",
    "react", "angular", "vue", "node.js", "django", "flask", "fastapi", "spring", "aws", "azure", "gcp", "docker", "kubernetes", "jenkins", "terraform",
    "git", "linux", "mongodb", "postgresql", "mysql", "redis", "elasticsearch", "machine learning", "deep learning", "tensorflow", "pytorch", "nlp",
    "data science", "data analysis", "pandas", "numpy", "scikit-learn", "rest api", "graphql", "microservices", "agile", "scrum", "ci/cd",
    "html", "css", "sass", "bootstrap", "tailwind", "figma", "photoshop", "android", "ios", "react native", "flutter", "unity", "unreal engine",
    "blockchain", "solidity", "web3", "cybersecurity", "penetration testing", "devops", "sre", "cloud computing", "serverless", "lambda", "tableau",
    "power bi", "excel", "sap", "salesforce", "jira", "confluence",
]
SOFT_SKILLS = [
    "leadership", "communication", "teamwork", "problem solving", "critical thinking", "time management", "project management", "collaboration", "adaptability",
    "creativity", "attention to detail", "analytical skills", "presentation", "negotiation", "conflict resolution", "mentoring", "stakeholder management",
]
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"
DEGREE = r"(?i)(B\.?S\.?|Bachelor(?:'s)?|M\.?S\.?|Master(?:'s)?|Ph\.?D\.?|MBA|B\.?Tech|M\.?Tech|B\.?E\.?|M\.?E\.?)[^,\n]*(?:in\s+)?([^,\n]+)?"
SPAN = r"(?i)(\d{4})\s*[-–]\s*(Present|\d{4})"
NOT_NAMES = ["resume", "cv", "curriculum"]
LINK_RULES = [
    ("linkedin", ["linkedin.com"]), ("github", ["github.com"]), ("gitlab", ["gitlab.com"]), ("stackoverflow", ["stackoverflow.com"]),
    ("twitter", ["twitter.com", "x.com"]), ("email", ["mailto:"]), ("portfolio", ["behance", "dribbble", "portfolio"]),
]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def email(text: Column) -> Column:
    return F.when(~text.contains("@"), "").otherwise(F.left(F.regexp_extract(text, EMAIL, 0), F.lit(254)))


def phone(text: Column) -> Column:
    """The first match; of +919876543210 the first ten digits after the sign, as the one pattern that can match takes them."""
    return F.left(F.regexp_extract(text, PHONE, 0), F.lit(50))


#: White space in the sense of (?U)\\s.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def name(text: Column) -> Column:
    """The first of the first five lines with at most four words, no digit and no heading word; else empty. White space before the first line doesn't count; only the text's begin is cut into lines."""
    lines = F.transform(F.slice(F.split(F.ltrim(text, F.lit(WHITE)), "\n", 6), 1, 5), lambda line: F.trim(line, F.lit(WHITE)))

    def fits(line: Column) -> Column:
        words = F.size(F.split(line, r"(?U)\s+"))
        heading = F.lit(False)
        for w in NOT_NAMES:
            heading = heading | F.lower(line).contains(w)
        return (line != "") & (words <= 4) & ~line.rlike(r"(?U)\d") & ~heading

    return F.left(F.coalesce(F.get(F.filter(lines, fits), F.lit(0)), F.lit("")), F.lit(255))


def display(skill: str) -> str:
    return skill.title()


def skills(text: Column) -> Column:
    """Sorted display names of the keywords that the text contains, with no word boundary."""
    return matching([(s, display(s)) for s in [*TECH_SKILLS, *SOFT_SKILLS]])(F.lower(text))


def with_skills(rows: DataFrame, text: str = "text", name: str = "skills") -> DataFrame:
    """rows with their texts' skills; keywords of a table are keywords.with_matches."""
    return rows.withColumn(name, skills(F.col(text)))


def education(text: Column) -> Column:
    """The first three degree tokens (they match inside words)."""
    return F.slice(F.regexp_extract_all(text, F.lit(DEGREE), 1), 1, 3)


def job_spans(text: Column) -> Column:
    """The first five year ranges as `start - end`."""
    found = F.slice(F.regexp_extract_all(text, F.lit(SPAN), 0), 1, 5)
    return F.transform(found, lambda m: F.concat(F.left(m, F.lit(4)), F.lit(" - "), F.regexp_replace(m, r"^\d{4}\s*[-–]\s*", "")))


def experience_years(text: Column, as_of_year: int, most: float = 50.0) -> Column:
    """The sum of the spans' years, overlaps counted twice, none below zero."""

    def years(span: Column) -> Column:
        start = F.split_part(span, F.lit(" - "), F.lit(1)).cast("int")
        end = F.split_part(span, F.lit(" - "), F.lit(2))
        last = F.coalesce(end.try_cast("int"), F.lit(as_of_year))  # else "Present"
        return F.greatest(F.lit(0), last - start)

    total = F.aggregate(F.transform(job_spans(text), years), F.lit(0), lambda s, x: s + x)
    return F.least(total.cast("double"), F.lit(most))


def link_class(url: Column) -> Column:
    """The first rule with a substring in the url; x.com also hits netflix.com."""
    low, out = F.lower(url), None
    for kind, parts in LINK_RULES:
        hit = low.contains(parts[0])
        for p in parts[1:]:
            hit = hit | low.contains(p)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")
