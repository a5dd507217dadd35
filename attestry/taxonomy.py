"""Closed vocabularies and rule tables. All values here are fixed: results must use exactly these."""

from __future__ import annotations

TAXONOMY_VERSION = "1.0.0"
QUESTION_SET_VERSION = "1.0.0"
MODEL = "jev-1.13.0"

# Primary types and traits, in display order.
PRIMARY = ("unit", "integration", "contract", "end_to_end", "performance", "smoke", "other", "unknown")
TRAITS = (
    "property", "fuzz", "regression", "golden", "snapshot", "parameterized", "concurrency", "database", "filesystem", "network", "containerized", "time_sensitive",
)
SPLITS = ("development", "holdout")
LANGUAGES = ("go", "kotlin")

# Trait -> the features that establish it without a model.
TRAIT_FEATURES = {
    "fuzz": ("go fuzz function",),
    "golden": ("golden comparison call",),
    "snapshot": ("snapshot assertion call",),
    "parameterized": ("go table-driven subtest loop", "kotlin @ParameterizedTest annotation"),
    "concurrency": ("calls t.Parallel",),
}
DETERMINISTIC = tuple(t for t in TRAITS if t in TRAIT_FEATURES)
ASKED = tuple(t for t in TRAITS if t not in TRAIT_FEATURES)

# Import path -> signal; first the exact rules, then those that also match below the path.
EXACT_IMPORTS = (
    ("github.com/testcontainers/testcontainers-go", "testcontainers"),
    ("github.com/stretchr/testify", "testify"),
    ("github.com/stretchr/testify/assert", "testify"),
    ("github.com/stretchr/testify/require", "testify"),
    ("database/sql", "database/sql"),
    ("net/http/httptest", "httptest"),
    ("net/http", "net/http"),
    ("os/exec", "os/exec"),
    ("os", "os"),
    ("time", "time"),
    ("sync", "sync"),
)
PREFIX_IMPORTS = (
    ("org.testcontainers", "testcontainers"),
    ("org.junit.jupiter.params", "junit params"),
    ("org.junit.jupiter", "junit jupiter"),
    ("org.springframework", "spring"),
    ("java.sql", "java.sql"),
    ("javax.sql", "javax.sql"),
    ("kotlinx.coroutines", "kotlinx.coroutines"),
    ("io.mockk", "mockk"),
    ("io.kotest", "kotest"),
    ("kotlin.test", "kotlin.test"),
)

# Directories never walked, file name conventions, path markers of Kotlin tests.
PRUNED = (".git", ".hg", ".svn", ".gradle", ".idea", "node_modules", "vendor", "build", "target", "out")
KOTLIN_STEMS = ("Test", "Tests", "TestSuite", "TestCase", "Spec")
KOTLIN_PATHS = ("/src/test/", "/src/androidtest/", "/src/integrationtest/", "/test/kotlin/")

# Annotations.
TEST_ANNOTATIONS = ("Test", "ParameterizedTest", "RepeatedTest", "TestFactory", "TestTemplate")
SOURCE_ANNOTATIONS = ("ValueSource", "MethodSource", "CsvSource", "CsvFileSource", "EnumSource", "NullSource", "EmptySource", "NullAndEmptySource", "ArgumentsSource")

# Bounds.
FILE_BYTES = 4 << 20
SOURCE_BYTES = 8 << 10
LIST_ENTRIES = 64
RUN_TESTS = 2000
REQUEST_BYTES = 64 << 10
LINE_BYTES = 2 << 20
TRUNCATED = "\n// ... evidence truncated ..."
SUM_TOLERANCE = 0.02
PRESENT_FROM = 0.5
