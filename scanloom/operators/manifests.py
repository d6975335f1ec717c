"""Frameworks by dependency manifests: package.json, requirements.txt, setup.py, pom.xml, build.gradle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.functions.paths import base_name

# The frameworks that are told apart.
JS = ("express", "prisma", "@prisma/client", "sequelize")
PYTHON = ("django", "flask", "sqlalchemy")
JAVA = ("spring-boot", "spring-data-jpa", "javax.persistence", "jakarta.persistence")
# What ends a requirement's name; the first of these that occurs cuts, whichever stands leftmost.
SEPARATORS = ("==", ">=", "<=", "~=", "!=", ">", "<", "[")


def _array(items: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def package_json(text: Column) -> Column:
    """Known names among dependencies and devDependencies; broken JSON gives none."""
    doc = F.from_json(text, "dependencies map<string,string>, devDependencies map<string,string>")
    keys = F.array_union(F.coalesce(F.map_keys(doc["dependencies"]), F.array().cast("array<string>")), F.coalesce(F.map_keys(doc["devDependencies"]), F.array().cast("array<string>")))
    return F.array_intersect(_array(JS), keys)


def requirement_name(line: Column, separators: tuple[str, ...]) -> Column:
    """The name before the first separator of the list that occurs at all."""
    out = F.when(F.lit(False), line)
    for s in separators:
        out = out.when(F.instr(line, s) > 0, F.substring_index(line, s, 1))
    return F.lower(F.trim(out.otherwise(line)))


def requirements_txt(text: Column) -> Column:
    """Known names in a requirements file; comments and blank lines don't count."""
    ls = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))
    return F.array_intersect(_array(PYTHON), F.transform(ls, lambda x: requirement_name(x, (*SEPARATORS, " "))))


def setup_py(text: Column) -> Column:
    """Known names in install_requires."""
    part = F.regexp_extract(text, r"(?s)install_requires\s*=\s*\[(.*?)\]", 1)
    return F.array_intersect(_array(PYTHON), F.transform(F.regexp_extract_all(part, F.lit("['\"]([^'\"]+)['\"]"), F.lit(1)), lambda x: requirement_name(x, SEPARATORS)))


def _java(names: Column, loose: bool) -> Column:
    hit = lambda f: F.exists(names, lambda n: n.contains("data-jpa") if loose and f == "spring-data-jpa" else n.contains(f))
    return F.array_compact(F.array(*[F.when(hit(f), F.lit(f)) for f in JAVA]))


def pom_xml(text: Column) -> Column:
    """Known names in group and artifact ids of direct dependencies; broken XML gives none."""
    clean = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"(?s)<dependencyManagement>.*?</dependencyManagement>", "")
    blocks = F.regexp_extract_all(clean, F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    ids = F.transform(blocks, lambda b: F.lower(F.concat(F.regexp_extract(b, r"<artifactId>\s*(.*?)\s*</artifactId>", 1), F.lit(" "), F.regexp_extract(b, r"<groupId>\s*(.*?)\s*</groupId>", 1))))
    return F.when(text.contains("<project"), _java(ids, True)).otherwise(F.array().cast("array<string>"))


def build_gradle(text: Column) -> Column:
    """Known names in dependency declarations."""
    return _java(F.transform(F.regexp_extract_all(text, F.lit("(?:implementation|compile|api|runtimeOnly)\\s+['\"]([^'\"]+)['\"]"), F.lit(1)), lambda x: F.lower(x)), False)


def detect(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(language, framework) over all manifests; JavaScript's count for TypeScript too.  Other files are not parsed."""
    b, t = base_name(F.col(path_col)), F.col(text_col)
    rows = files.where(b.isin("package.json", "requirements.txt", "setup.py", "pom.xml", "build.gradle"))
    found = F.when(b == "package.json", package_json(t)).when(b == "requirements.txt", requirements_txt(t)).when(b == "setup.py", setup_py(t)).when(b == "pom.xml", pom_xml(t)).otherwise(build_gradle(t))
    langs = F.when(b == "package.json", _array(("javascript", "typescript"))).when(b.isin("requirements.txt", "setup.py"), _array(("python",))).otherwise(_array(("java",)))
    return rows.select(F.explode(langs).alias("language"), found.alias("f")).select("language", F.explode("f").alias("framework")).distinct()


def project_context(found: DataFrame) -> DataFrame:
    """(language, frameworks) with sorted names; at most the known ones."""
    return found.groupBy("language").agg(F.array_sort(F.collect_set("framework")).alias("frameworks"))
