"""Column functions over text: hashes, ids, tokens, size estimates, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The file kinds by suffix.
MARKDOWN_SUFFIXES = (".md", ".mdx")
CODE_SUFFIXES = (
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".rs", ".go", ".java",
    ".c", ".h", ".cpp", ".hpp", ".cs", ".sh", ".ps1", ".sql", ".css", ".scss",
    ".lua", ".rb", ".php", ".kt", ".swift",
)
TEXT_SUFFIXES = (".txt", ".rst")
CONFIG_SUFFIXES = (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".xml")
PDF_SUFFIXES = (".pdf",)
CONFIG_NAMES = ("Dockerfile", "Makefile", "Justfile", "Procfile")

# Provenance rules.
AGENT_DOCS = ("agents.md", "claude.md", ".cursorrules", "conventions.md")
FOREIGN_SEGMENTS = ("vendor", "vendored", "third_party", "thirdparty", "external")

# Token estimate, characters per token by script.
CYRILLIC_CPT, CJK_CPT, LATIN_CPT, OTHER_CPT = 1.9, 1.0, 3.3, 2.4
MESSAGE_OVERHEAD = 4

WORD = r"[A-Za-z0-9_]+|[Ѐ-ӿ]+"
CAMEL_PART = r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"
INNER_BOUNDARY = r"[A-Za-z0-9_][A-Z_]|[A-Z_][0-9]|_"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
CYRILLIC = r"[Ѐ-ӿ]"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(rel_path: Column, ordinal: Column, text: Column) -> Column:
    return F.sha2(F.concat(rel_path, ordinal.cast("string"), text), 256)


def document_id(collection: Column, rel_path: Column) -> Column:
    return F.concat_ws("/", collection, rel_path)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased last suffix of the file name; a leading or trailing dot starts none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.].*?(\.[^.]+)$|^$", 1))


def content_kind(path: Column) -> Column:
    """markdown / code / text / config / pdf, or NULL for a file that is not indexed."""
    ext, name = suffix(path), file_name(path)
    return (
        F.when(ext.isin(*MARKDOWN_SUFFIXES), "markdown")
        .when(ext.isin(*CODE_SUFFIXES), "code")
        .when(ext.isin(*TEXT_SUFFIXES), "text")
        .when(ext.isin(*CONFIG_SUFFIXES), "config")
        .when(ext.isin(*PDF_SUFFIXES), "pdf")
        .when(name.isin(*CONFIG_NAMES) | name.startswith("Dockerfile"), "config")
    )


def is_semantic(kind: Column) -> Column:
    """Config is searched by word only and never embedded."""
    return kind != "config"


def provenance(path: Column, kind: Column, project: Column, owner_project: str | None = None) -> Column:
    """``local_foreign`` for text someone else wrote, else ``local_owned``."""
    low = F.lower(path)
    agent_file = file_name(low).isin(*AGENT_DOCS)
    if owner_project is not None:
        agent_file = agent_file & ~project.eqNullSafe(F.lit(owner_project))
    vendored = F.arrays_overlap(
        F.split(low, "/"), F.array(*[F.lit(s) for s in FOREIGN_SEGMENTS])
    )
    foreign = (kind == "pdf") | agent_file | vendored
    return F.when(foreign, "local_foreign").otherwise("local_owned")


def identifiers(text: Column) -> Column:
    """Identifiers with more than one camel part, followed by their parts, first-seen order."""
    tokens = F.filter(
        F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), lambda t: t.rlike(INNER_BOUNDARY)
    )
    exploded = F.transform(
        tokens,
        lambda t: F.concat(F.array(t), F.regexp_extract_all(t, F.lit(CAMEL_PART), F.lit(0))),
    )
    # one whole token and one part means the token has a single part
    return F.array_distinct(F.flatten(F.filter(exploded, lambda parts: F.size(parts) > 2)))


def lex_tokens(text: Column) -> Column:
    """Lower-cased words; camel-case and snake-case words also give their parts.

    Repeats are kept: the array is the bag of words used for term frequencies.
    """
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def spread(word: Column) -> Column:
        parts = F.regexp_extract_all(word, F.lit(CAMEL_PART), F.lit(0))
        camel = F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))
        snake = F.when(
            F.contains(word, F.lit("_")), F.filter(F.split(word, "_"), lambda p: p != "")
        ).otherwise(F.array().cast("array<string>"))
        # most words have no inner boundary, and one test settles that
        return F.when(word.rlike(INNER_BOUNDARY), F.concat(F.array(word), camel, snake)).otherwise(F.array(word))

    return F.transform(F.flatten(F.transform(words, spread)), F.lower)


def plain_words(text: Column) -> Column:
    """Lower-cased words without parts (a cheaper bag when no identifiers are expected)."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def has_cyrillic(text: Column) -> Column:
    return text.rlike(CYRILLIC)


def approx_tokens(text: Column) -> Column:
    """max(1, round-half-even(characters / 3.6))."""
    return F.greatest(F.lit(1), F.bround(F.char_length(text) / F.lit(3.6), 0).cast("long"))


def _count_of(text: Column, char_class: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, char_class, ""))


def estimate_tokens(text: Column) -> Column:
    """Script-aware upper estimate of model tokens; never below the number of words."""
    cyr = _count_of(text, r"[Ѐ-ӿԀ-ԯ]")
    cjk = _count_of(text, r"[一-鿿぀-ヿ]")
    lat = _count_of(text, r"[A-Za-z]")
    other = F.char_length(text) - cyr - cjk - lat
    est = cyr / CYRILLIC_CPT + cjk / CJK_CPT + lat / LATIN_CPT + other / OTHER_CPT
    words = F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))
    return F.when(F.char_length(text) == 0, F.lit(0).cast("long")).otherwise(
        F.greatest(est.cast("long") + 1, words.cast("long"))
    )


def item_cost(text: Column) -> Column:
    return estimate_tokens(text) + MESSAGE_OVERHEAD


def snippet(text: Column, limit: int = 600) -> Column:
    return F.when(F.char_length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, 1, limit), F.lit("…"))
    )


def link_targets(text: Column, pattern: str = r"\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]") -> Column:
    """Distinct trimmed link targets in first-seen order (wiki links unless told otherwise)."""
    return F.array_distinct(
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda t: F.trim(t))
    )


def path_stem(path: Column) -> Column:
    """Lower-cased file name without its last extension."""
    return F.lower(F.regexp_replace(F.element_at(F.split(F.trim(path), "/"), -1), r"\.[^.]*$", ""))


# Words ignored when two goals are compared.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "can", "do", "does", "for",
    "from", "has", "have", "in", "is", "it", "its", "make", "of", "on", "or", "that", "the",
    "then", "this", "to", "was", "were", "will", "with",
)


def goal_words(goal: Column) -> Column:
    """Meaningful words of a goal: lower-cased, stop words out, longer than one, distinct."""
    words = F.regexp_extract_all(F.lower(goal), F.lit("[a-z0-9_]+"), F.lit(0))
    kept = F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))
    return F.filter(F.array_distinct(kept), lambda w: F.char_length(w) > 1)


def goal_signature(goal: Column, project: Column) -> Column:
    return F.concat(
        F.lower(F.coalesce(project, F.lit(""))),
        F.lit(":"),
        F.array_join(F.array_sort(goal_words(goal)), " "),
    )


def human_duration(seconds: Column) -> Column:
    """Briefing form: ``42s``, ``4m``, ``1.5h``."""
    return (
        F.when(seconds < 60, F.format_string("%ds", F.floor(seconds)))
        .when(seconds < 3600, F.format_string("%dm", F.floor(seconds / 60)))
        .otherwise(F.format_string("%.1fh", seconds / 3600))
    )


def elapsed_label(seconds: Column) -> Column:
    """Queue form: ``12s``, ``4m12s``, ``1h5m``; negative spans read ``0s``."""
    total = F.greatest(F.lit(0), F.round(seconds)).cast("long")
    h, m, s = F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60
    return (
        F.when(h > 0, F.format_string("%dh%dm", h, m))
        .when(m > 0, F.format_string("%dm%02ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )


def iso_timestamp(stamp: Column) -> Column:
    """Timestamp of an ISO-8601 string, NULL when it cannot be read."""
    return F.try_to_timestamp(stamp)


def iso_seconds(stamp: Column) -> Column:
    """Epoch seconds (fractional) of an ISO-8601 string, NULL when it cannot be read."""
    return F.unix_micros(F.try_to_timestamp(stamp)) / F.lit(1_000_000.0)
