"""Question bank: filters, search, quotas, statistics, and classification by keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnmill.functions.scalar import first_match

# Keywords by subject, and keywords by topic in order.
BIOLOGY = (
    "cell", "organism", "plant", "animal", "gene", "protein", "photosynthesis", "respiration", "dna", "mitosis", "meiosis",
    "ecosystem", "species", "evolution", "bacteria", "virus", "tissue", "organ", "blood", "heart", "brain", "muscle",
)
CHEMISTRY = (
    "atom", "molecule", "element", "compound", "reaction", "chemical", "bond", "acid", "base", "solution", "mixture",
    "periodic", "electron", "proton", "neutron", "ion", "ph", "oxidation", "reduction", "catalyst", "polymer",
)
PHYSICS = (
    "force", "energy", "velocity", "acceleration", "mass", "gravity", "friction", "momentum", "wave", "light", "sound",
    "electric", "magnetic", "circuit", "voltage", "current", "heat", "temperature", "pressure", "motion", "power",
)
TOPICS = (
    (("photosynthesis", "chlorophyll", "chloroplast"), "Photosynthesis"),
    (("respiration", "glucose", "atp"), "Cellular Respiration"),
    (("gene", "genetic", "inherit", "trait", "dna"), "Genetics"),
    (("evolution", "natural selection", "adaptation", "species"), "Evolution"),
    (("ecosystem", "habitat", "environment", "population"), "Ecology"),
    (("atom", "electron", "proton", "nucleus", "orbital"), "Atomic Structure"),
    (("bond", "ionic", "covalent", "molecule"), "Chemical Bonding"),
    (("acid", "base", "ph", "neutralize"), "Acids and Bases"),
    (("newton", "force", "motion", "inertia"), "Newton's Laws"),
    (("energy", "kinetic", "potential", "work"), "Energy"),
    (("wave", "frequency", "amplitude", "wavelength"), "Waves"),
    (("electric", "current", "voltage", "circuit"), "Electricity"),
    (("magnet", "magnetic", "pole", "field"), "Magnetism"),
)
COMPETITION_TOPICS = (
    (("photosynthesis", "chlorophyll", "chloroplast"), "Photosynthesis"),
    (("respiration", "glucose", "atp", "cellular respiration"), "Cellular Respiration"),
    (("gene", "genetic", "inherit", "trait", "dna", "chromosome"), "Genetics"),
    (("evolution", "natural selection", "adaptation", "species"), "Evolution"),
    (("ecosystem", "habitat", "environment", "population", "community"), "Ecology"),
    (("atom", "electron", "proton", "neutron", "nucleus", "orbital"), "Atomic Structure"),
    (("periodic", "element", "group", "period", "atomic number"), "Periodic Table"),
    (("bond", "ionic", "covalent", "molecule", "valence"), "Chemical Bonding"),
    (("acid", "base", "ph", "neutralize", "titration"), "Acids and Bases"),
    (("mole", "stoichiometry", "molar mass", "limiting reactant"), "Stoichiometry"),
    (("newton", "force", "motion", "inertia", "acceleration"), "Newton's Laws"),
    (("energy", "kinetic", "potential", "work", "power", "joule"), "Energy and Work"),
    (("wave", "frequency", "amplitude", "wavelength", "sound"), "Waves and Sound"),
    (("light", "optic", "lens", "mirror", "reflection", "refraction"), "Light and Optics"),
    (("electric", "current", "voltage", "circuit", "ohm", "resistor"), "Electricity"),
    (("magnet", "magnetic", "pole", "field", "flux"), "Magnetism"),
    (("heat", "temperature", "entropy", "enthalpy", "thermodynamics"), "Thermodynamics"),
    (("earth", "geology", "rock", "mineral", "plate tectonics", "fault"), "Earth Science"),
    (("star", "planet", "orbit", "solar system", "galaxy", "telescope"), "Astronomy"),
    (("weather", "climate", "precipitation", "atmosphere", "front"), "Weather"),
)
SUBJECT_CODES = (
    ("BIO", "Biology"), ("CHEM", "Chemistry"), ("PHYS", "Physics"), ("ES", "Earth Science"), ("MATH", "Mathematics"), ("ASTR", "Astronomy"),
    ("ENERGY", "Energy"), ("GENERAL", "General Science"), ("CS", "Computer Science"), ("EARTH", "Earth Science"), ("SPACE", "Astronomy"),
)
SHORT_SUBJECTS = (
    ("Bio", "Biology"), ("Chem", "Chemistry"), ("Phys", "Physics"), ("Earth", "Earth Science"),
    ("Math", "Mathematics"), ("Astro", "Astronomy"), ("Energy", "Energy"), ("Gen", "General Science"),
)


def once(value: Column, f) -> Column:
    """``f`` of a value that is computed once a row, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def votes(low: Column, words) -> Column:
    """How many of the words a lowered text holds."""
    total = F.lit(0)
    for w in words:
        total = total + low.contains(w).cast("int")
    return total


def subject_by_votes(text: Column) -> Column:
    """The subject with most keywords in the text; ties go to biology, then chemistry."""
    counts = lambda low: F.struct(votes(low, BIOLOGY).alias("b"), votes(low, CHEMISTRY).alias("c"), votes(low, PHYSICS).alias("p"))
    most = lambda v: F.when((v["b"] >= v["c"]) & (v["b"] >= v["p"]), "Biology").when(v["c"] >= v["p"], "Chemistry").otherwise("Physics")
    return once(once(F.lower(text), counts), most)


def topic(text: Column, rules=TOPICS) -> Column:
    """The first topic with a keyword in the text; null if there is none."""
    return once(F.lower(text), lambda low: first_match(low, rules))


def standard_subject(category: Column) -> Column:
    """Subject of a category: an exact code, else the first code inside it, else a short form."""
    top = F.upper(F.trim(category))
    out = F.when(category.isNull() | (category == ""), "General Science")
    for code, name in SUBJECT_CODES:
        out = out.when(top == code, name)
    for code, name in SUBJECT_CODES:
        out = out.when(F.upper(category).contains(code), name)
    for short, name in SHORT_SUBJECTS:
        out = out.when(F.lower(category).contains(short.lower()), name)
    return out.otherwise("General Science")


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows equal to every value given; None is no filter, and leaves nothing in the plan."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def lookup(df: DataFrame, **key) -> DataFrame:
    """The rows of a key, as a filter that reaches the scan."""
    return where_equal(df, **key)


def search(df: DataFrame, query: str, columns, limit: int = 20, order: str = "question_id", case_sensitive: bool = False) -> DataFrame:
    """The first rows, in order of insertion, in which any of the columns contains the query."""
    hit = F.lit(False)
    for c in columns:
        text = F.col(c) if case_sensitive else F.lower(F.col(c))
        hit = hit | F.coalesce(text.contains(query if case_sensitive else query.lower()), F.lit(False))
    return df.where(hit).orderBy(order).limit(limit)


def random_questions(df: DataFrame, limit: int = 10, seed: int = 0, key=("question_id", "source"), **filters) -> DataFrame:
    """A draw that repeats with its seed: the rows of least hash."""
    return where_equal(df, **filters).orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(limit)


def capped(df: DataFrame, max_rows: int | None, order, cap_first: bool = True, **filters) -> DataFrame:
    """The import's cap, before the filters or after them, in a given order."""
    if not cap_first:
        df = where_equal(df, **filters)
    if max_rows is not None:
        df = df.orderBy(order).limit(max_rows)
    return where_equal(df, **filters) if cap_first else df


def category_quota(df: DataFrame, amount: int, category: str, order: str, categories: int | None = None) -> DataFrame:
    """At most max(1, amount // categories) rows of each category, in order."""
    n = categories or df.select(category).distinct().count()
    w = Window.partitionBy(category).orderBy(order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(1, amount // max(1, n))).drop("rn")


def science_questions(df: DataFrame, amount: int = 10, difficulty: str | None = None, include_math: bool = True, order: str = "question_id") -> DataFrame:
    kept = where_equal(df, difficulty=difficulty)
    return category_quota(kept if include_math else kept.where(F.col("subject") != "Mathematics"), amount, "subject", order)


def statistics(df: DataFrame) -> DataFrame:
    """Per source and subject: total and counts by difficulty."""
    level = F.col("difficulty")
    return df.groupBy("source", "subject").agg(F.count("*").alias("total"), *[F.count_if(level == x).alias(x) for x in ("easy", "medium", "hard")])


def bank_statistics(df: DataFrame) -> DataFrame:
    """(kind, value, n): total, by subject, by difficulty and distinct topics, in one scan."""
    kind = F.when(F.grouping_id() == 1, "subject").when(F.grouping_id() == 2, "difficulty").otherwise("total")
    got = df.groupingSets([["subject"], ["difficulty"], []], "subject", "difficulty").agg(F.count("*").alias("n"), F.count_distinct("topic").alias("topics"), kind.alias("kind"))
    counts = got.select("kind", F.coalesce("subject", "difficulty", F.lit("all")).alias("value"), "n")
    return counts.unionByName(got.where("kind = 'total'").select(F.lit("topics").alias("kind"), F.lit("all").alias("value"), F.col("topics").alias("n")))


def topics(df: DataFrame, *subjects: str | None) -> DataFrame:
    """The topics of the given subjects, of all if none is given, in one scan."""
    named = [s for s in subjects if s is not None]
    kept = df.where(F.col("subject").isin(named)) if named else df
    return kept.where(F.col("topic").isNotNull()).select("topic").distinct().orderBy("topic")


def add_questions(bank: DataFrame, new: DataFrame, key: str = "question_id") -> tuple[DataFrame, DataFrame]:
    """(bank with the new rows whose key it lacks, report of added or not per new row)."""
    known = bank.select(key).distinct().withColumn("known", F.lit(True))
    report = new.join(known, key, "left").withColumn("added", F.col("known").isNull())
    return bank.unionByName(report.where("added").select(*new.columns), allowMissingColumns=True), report.select(key, "added")
