"""Stratified, weighted question plans that a seed fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Category shares and difficulty weights.
SHARES = {"technical": 0.5, "behavioral": 0.2, "situational": 0.2, "project": 0.1}
WEIGHTS = {
    "fresher": (0.6, 0.3, 0.1),
    "junior": (0.4, 0.5, 0.1),
    "mid": (0.2, 0.5, 0.3),
    "senior": (0.1, 0.4, 0.5),
    "lead": (0.05, 0.35, 0.6),
}
DIFFICULTIES = ("easy", "medium", "hard")
# Question templates of each category and difficulty.
TEMPLATES = {
    "technical": {
        "easy": [
            "Can you explain what {skill} is and how you've used it?",
            "What are the basic concepts of {skill}?",
            "Describe a simple project where you used {skill}.",
        ],
        "medium": [
            "How would you optimize performance in a {skill} application?",
            "What are best practices when working with {skill}?",
            "Explain the architecture of a {skill} solution you've built.",
            "How do you handle errors and debugging in {skill}?",
        ],
        "hard": [
            "Describe a complex problem you solved using {skill} and your approach.",
            "How would you design a scalable system using {skill}?",
            "What are the trade-offs you consider when using {skill} vs alternatives?",
            "Explain how {skill} works under the hood.",
        ],
    },
    "behavioral": {
        "easy": [
            "Tell me about yourself and your background.",
            "Why are you interested in this position?",
            "What motivates you in your work?",
        ],
        "medium": [
            "Describe a challenging project you worked on and how you handled it.",
            "Tell me about a time you had to learn a new technology quickly.",
            "How do you prioritize tasks when working on multiple projects?",
            "Describe a situation where you had to collaborate with a difficult team member.",
        ],
        "hard": [
            "Tell me about a time you failed and what you learned from it.",
            "Describe a situation where you had to make a difficult decision with limited information.",
            "How do you handle conflicting priorities from different stakeholders?",
        ],
    },
    "situational": {
        "easy": [
            "How would you approach learning a new framework for a project?",
            "What would you do if you found a bug in production?",
        ],
        "medium": [
            "How would you handle a situation where requirements change mid-project?",
            "What would you do if you disagreed with your manager's technical decision?",
            "How would you onboard a new team member?",
        ],
        "hard": [
            "How would you design and lead a migration of a legacy system?",
            "What would you do if a critical team member left during a crucial project phase?",
            "How would you handle a security breach in production?",
        ],
    },
    "project": {
        "easy": [
            "Tell me about a project you're proud of.",
            "What was your role in your most recent project?",
        ],
        "medium": [
            "What was the most challenging aspect of your recent project?",
            "How did you ensure code quality in your projects?",
            "Describe how you collaborated with your team on a project.",
        ],
        "hard": [
            "How did you architect the solution for your most complex project?",
            "What trade-offs did you make in your project and why?",
            "How did you measure the success of your project?",
        ],
    },
}


def quotas(n: int) -> dict[str, int]:
    """Questions of each category; the sum may fall short of n."""
    return {c: int(n * s) or (c == "project") * 1 for c, s in SHARES.items()}


def quotas_of(plans: DataFrame) -> DataFrame:
    """n, category and quota of each different plan size n of a table."""
    shares = F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.lit(s).alias("share")) for c, s in SHARES.items()))).alias("s")
    whole = F.floor(F.col("n") * F.col("s.share"))
    quota = F.when((F.col("s.category") == "project") & (whole == 0), F.lit(1)).otherwise(whole).cast("long")
    return plans.select(F.col("n").cast("long").alias("n")).distinct().select("n", shares).select("n", "s.category", quota.alias("quota"))


def draw(seed: int, key: Column, category: Column, number: Column, salt: int) -> Column:
    """A number in [0, 1) that seed, key, category, number and salt fix: the first 32 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), category, number.cast("string"), F.lit(str(salt)))
    return F.conv(F.left(F.md5(text.cast("binary")), F.lit(8)), 16, 10).cast("long") / float(1 << 32)


def plan(candidates: DataFrame, n: int, *, key: str, level: str, skills: str, seed: int = 42) -> DataFrame:
    """key, position, category, difficulty, text and skill_tag of each candidate's questions.

    Each category's quota draws a difficulty by the level's weights (mid's for an unknown one), then one of the templates of
    that category and difficulty, then a skill if the template asks for one and there are any; the questions are shuffled and
    cut to n. All draws are hashes, and a candidate's questions are one array: there is no shuffle.
    """
    slots = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(k).alias("number")) for c, m in quotas(n).items() for k in range(m)))
    ranks = {name: F.array(F.lit(w[0]), F.lit(w[0] + w[1])) for name, w in WEIGHTS.items()}
    cuts = F.lit(None)
    for name, pair in ranks.items():
        cuts = F.when(F.col(level) == name, pair) if name == next(iter(ranks)) else cuts.when(F.col(level) == name, pair)
    cuts = cuts.otherwise(ranks["mid"])
    table = F.create_map(*(x for c, by in TEMPLATES.items() for d, texts in by.items() for x in (F.lit(f"{c} {d}"), F.array(*map(F.lit, texts)))))

    def question(slot: Column) -> Column:
        def u(salt: int) -> Column:
            return draw(seed, F.col(key), slot["category"], slot["number"], salt)

        difficulty = F.when(u(1) < F.get("_cuts", F.lit(0)), DIFFICULTIES[0]).when(u(1) < F.get("_cuts", F.lit(1)), DIFFICULTIES[1]).otherwise(DIFFICULTIES[2])
        return F.struct(u(4).alias("place"), slot["category"].alias("category"), slot["number"].alias("number"), difficulty.alias("difficulty"), u(2).alias("which"), u(3).alias("skill"))

    drawn = F.slice(F.array_sort(F.transform(slots, question)), 1, n) if n and quotas(n) else F.array().cast("array<struct<category:string,difficulty:string,which:double,skill:double>>")
    rows = candidates.withColumn("_cuts", cuts).select(key, F.col(skills).alias("_skills"), F.posexplode(drawn).alias("position", "q"))
    texts = F.element_at(table, F.concat_ws(" ", "q.category", "q.difficulty"))
    rows = rows.withColumn("_texts", texts).withColumn("_text", F.get("_texts", F.floor(F.col("q.which") * F.size("_texts")).cast("int")))
    skill = F.when(F.contains("_text", F.lit("{skill}")) & (F.size("_skills") > 0), F.get("_skills", F.floor(F.col("q.skill") * F.size("_skills")).cast("int")))
    rows = rows.withColumn("skill_tag", F.coalesce(skill, F.lit("")))
    return rows.select(key, "position", F.col("q.category").alias("category"), F.col("q.difficulty").alias("difficulty"), fill(F.col("_text"), F.col("skill_tag")).alias("text"), "skill_tag")


def fill(template: Column, skill: Column) -> Column:
    """The template with the skill for {skill}; left as it is where there is no skill."""
    return F.when(F.coalesce(skill, F.lit("")) == "", template).otherwise(F.replace(template, F.lit("{skill}"), skill))


def shown_skills(skills: Column, most: int = 15) -> Column:
    """The first skills and how many more there are."""
    more = F.when(F.size(skills) > most, F.array(F.concat(F.lit("+"), (F.size(skills) - most).cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.slice(skills, 1, most), more)


def prompt_skills(skills: Column, most: int = 10) -> Column:
    return F.when(F.size(skills) > 0, F.array_join(F.slice(skills, 1, most), ", ")).otherwise("Not specified")
