"""The role of a file by its path alone, with the rules of each language."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rules(NamedTuple):
    """What a language tells files by, in lower case; patterns are shell patterns of file names."""

    endings: tuple[str, ...] = ()
    tests: tuple[str, ...] = ()
    test_dirs: tuple[str, ...] = ()
    config: tuple[str, ...] = ()
    vendor: tuple[str, ...] = ()
    support: tuple[str, ...] = ()


# The rules by language, and those of all.
RULES = {
    "go": Rules(("go",), ("*_test.go",), (), ("go.mod", "go.sum", "go.work", "go.work.sum", ".golangci.yml", ".golangci.yaml"), ("vendor",)),
    "java": Rules(
        ("java", "kt"), ("*test.java", "*tests.java", "*it.java", "*integrationtest.java", "*test.kt", "*tests.kt"), ("test", "tests"),
        ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradle.properties", "gradlew", "gradlew.bat", "checkstyle.xml", "spotbugs.xml"),
        ("build", "target", ".gradle", "out"),
    ),
    "javascript": Rules(
        ("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts"), ("*.test.js", "*.spec.js", "*.test.jsx", "*.spec.jsx", "*.test.ts", "*.spec.ts", "*.test.tsx", "*.spec.tsx"), ("__tests__",),
        ("package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "bun.lockb", "tsconfig.json", "jest.config.js", "jest.config.cjs", "jest.config.mjs", "jest.config.json", "jest.config.ts",
         "vitest.config.js", "vitest.config.ts", "vitest.config.cjs", "vitest.config.mjs", ".eslintrc", ".eslintrc.js", ".eslintrc.json", ".prettierrc", ".prettierrc.json"),
        ("node_modules", ".next", ".nuxt", ".turbo", ".cache", "coverage", "dist", "build"),
    ),
    "python": Rules(
        ("py", "pyi"), ("test_*.py", "*_test.py", "*_test_*.py"), ("test", "tests"),
        ("pyproject.toml", "setup.py", "setup.cfg", "noxfile.py", "requirements.txt", "requirements-dev.txt", "requirements.in", "pipfile", "pipfile.lock"),
        ("__pycache__", ".mypy_cache", ".pytest_cache", "site-packages", "vendor", ".venv", "venv", ".eggs"), ("conftest.py", "pytest.ini", "tox.ini"),
    ),
    "rust": Rules(("rs",), (), ("tests", "benches"), ("cargo.toml", "cargo.lock", "rust-toolchain", "rust-toolchain.toml", "rustfmt.toml", "clippy.toml"), ("target",)),
}
COMMON_VENDOR = ("__pycache__", ".mypy_cache", ".pytest_cache", "site-packages", "vendor", ".venv", "venv")
BUILD_DIRS = ("dist", "build", ".eggs")
CONFIG_ROOTS = (".github", ".circleci")
COMMON_CONFIG = (".travis.yml", "dockerfile", "docker-compose.yml")
FIXTURE_DIRS = ("fixtures", "fixture", "testdata", "mocks", "mock", "resources", "helpers", "support")
DOC_FILES = ("readme", "readme.md", "readme.rst", "changelog", "changelog.md", "history.md", "license", "license.md")
NO_DOCS = ("changelog", "change_log.md")


def merged(languages: Sequence[str] | None = None) -> Rules:
    """The rules of ``languages`` (all, where none of them is known) and the common ones as one."""
    known = [RULES[x] for x in sorted(RULES) if languages is None or x in languages] or list(RULES.values())
    each = [tuple(sorted({v for r in known for v in getattr(r, field)})) for field in Rules._fields]
    whole = Rules(*each)
    return whole._replace(vendor=tuple(sorted({*whole.vendor, *COMMON_VENDOR})), config=tuple(sorted({*whole.config, *COMMON_CONFIG})))


def test_name(rules: Rules) -> str:
    """The shell patterns of test files as one regular expression."""
    parts = [re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") for p in rules.tests]
    return "^(?:" + "|".join(parts) + ")$" if parts else "^$"


def file_role(parts: Column, languages: Sequence[str] | None = None) -> Column:
    """The first rule that holds for the lower-case parts of a path; ``languages`` narrows what tests are told by."""
    rules, tests = merged(), merged(languages)
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    first = F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise("")
    ending = F.regexp_extract(name, r".\.([^.]+)$", 1)
    among = lambda a, names: F.arrays_overlap(a, F.array(*map(F.lit, names)).cast("array<string>"))
    tested = name.rlike(test_name(tests)) & (name != "")
    in_docs = F.array_contains(folders, "docs")
    return (
        F.when(F.size(parts) == 0, "unknown").when(among(parts, rules.vendor) | among(parts, BUILD_DIRS), "generated_vendor")
        .when(first.isin(*CONFIG_ROOTS) | name.isin(*rules.config), "config_build").when(name.isin(*tests.support), "test_support")
        .when((first == "docs") | (in_docs & ~name.isin(*NO_DOCS)), "docs").when(name.isin(*DOC_FILES), "docs")
        .when(among(folders, tests.test_dirs), F.when(among(folders, FIXTURE_DIRS), "test_support").when(tested | ending.isin(*tests.endings), "test").otherwise("test_support"))
        .when(tested, "test").when(ending.isin(*rules.endings) | F.array_contains(folders, "src"), "prod").otherwise("unknown")
    )


def detected(scores: Column) -> Column:
    """The language of most confidence out of array<struct<confidence, name>>; the first name on a tie, ``unknown`` without any."""
    sure = F.filter(scores, lambda s: s["confidence"] > 0)
    best = F.array_min(F.transform(sure, lambda s: F.struct((-s["confidence"]).alias("c"), s["name"].alias("name"))))
    return F.coalesce(best["name"], F.lit("unknown"))
