"""Column builders over text: white space, tokens, hashes, lexical scores. All stay in the JVM.

"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's notion of white space as a Java character class.
SPACE = r"(?U)[\s\x1c-\x1f]+"
WORD = "[A-Za-z][A-Za-z0-9]*"
CAMEL = "[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])"

# Fixed value: English filler that queries are stripped of.
QUERY_STOP_WORDS = (
    "a an the of on in is are for to and or that with as be by it its this these from has have between over into every all any no"
).split()
# Fixed value: words of names that say which relation holds.
RELATION_WORDS = (
    "sym symmetry symmetric trans transitivity transitive refl reflexivity reflexive irreflexive comm commutativity commutative assoc associativity associative "
    "dec decidable decidability antisym antisymmetry inj injective surj surjective mono monotone monotonicity idempotent distributive cancel unique uniqueness "
    "exists existence trivial id identity inverse involutive preserves compat congr"
).split()
# Fixed value: words of names that no concept is called by.
NAME_STOP_WORDS = "of the a an is to and or in by for lemma theorem def definition bis aux alt".split()


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def compact_ws(c: Column | str) -> Column:
    """runs of white space become one space, none stays at the ends."""
    return F.trim(F.regexp_replace(text(c), SPACE, " "))


def any_of(c: Column, words: list[str]) -> Column:
    return c.isin(*words)


def hash_int(c: Column | str, digits: int = 8) -> Column:
    """The first hex digits of SHA-256 as a number; DECIMAL(20,0), as 16 digits don't fit a BIGINT."""
    return F.conv(F.substring(F.sha2(text(c), 256), 1, digits), 16, 10).cast("decimal(20,0)")


def token_id(c: Column | str) -> Column:
    """a 31-bit number for a token."""
    return (hash_int(c).cast("long") % 2147483648).cast("long")


def bucket(c: Column | str, dim: int) -> Column:
    """one of dim buckets for a token."""
    return (hash_int(c).cast("long") % dim).cast("int")


def words(c: Column | str) -> Column:
    return F.regexp_extract_all(text(c), F.lit(WORD), F.lit(0))


def camel_parts(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(CAMEL), F.lit(0)), F.lower)


def identifier_tokens(c: Column | str) -> Column:
    """each word in lower case, then its camel-case parts that differ from it; of two characters or more, in order."""
    return F.flatten(
        F.transform(
            words(c),
            lambda w: F.concat(
                F.filter(F.array(F.lower(w)), lambda x: F.length(x) >= 2),
                F.filter(camel_parts(w), lambda x: (F.length(x) >= 2) & (x != F.lower(w))),
            ),
        )
    )


def space_tokens(c: Column | str) -> Column:
    """Tokens of the hash embedder (F13): lower case, `_` as a space, split at white space."""
    return F.filter(F.split(F.replace(F.lower(text(c)), F.lit("_"), F.lit(" ")), SPACE), lambda x: x != "")


def query_terms(c: Column | str) -> Column:
    """words in lower case of two characters or more that are no filler; repeated ones stay."""
    return F.filter(F.transform(words(c), F.lower), lambda x: (F.length(x) >= 2) & ~any_of(x, QUERY_STOP_WORDS))


def token_set(*fields: Column | str) -> Column:
    """the distinct words and camel-case parts of all fields, of two characters or more."""
    one = lambda c: F.flatten(F.transform(words(c), lambda w: F.concat(F.array(F.lower(w)), camel_parts(w))))
    return F.array_distinct(F.filter(F.concat(*(one(c) for c in fields)), lambda x: F.length(x) >= 2))


def lexical_score(terms: Column, tokens: Column) -> Column:
    """1 for each term that is a token, 0.5 for one of five characters or more that shares a prefix with a token of
    five or more (one being the start of the other)."""
    longer = lambda t: F.exists(tokens, lambda d: (F.length(d) >= 5) & (F.startswith(d, t) | F.startswith(t, d)))
    worth = lambda t: F.when(F.array_contains(tokens, t), F.lit(1.0)).when((F.length(t) >= 5) & longer(t), F.lit(0.5)).otherwise(F.lit(0.0))
    return F.aggregate(F.transform(terms, worth), F.lit(0.0), lambda a, x: a + x)


def concept_stem(name: Column | str) -> Column:
    """the first token of a name that is no relation, no filler and no number; empty if there is none."""
    good = F.filter(identifier_tokens(name), lambda t: ~any_of(t, RELATION_WORDS) & ~any_of(t, NAME_STOP_WORDS) & ~t.rlike("^[0-9]+$"))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


def relation_signature(name: Column | str) -> Column:
    """the relation words of a name, sorted."""
    return F.array_sort(F.array_distinct(F.filter(identifier_tokens(name), lambda t: any_of(t, RELATION_WORDS))))


def cluster_key(library: Column | str, statement: Column | str, type_signature: Column | str, name: Column | str) -> Column:
    """library and statement without leading keyword and name and with one-letter variables erased."""
    first = F.coalesce(*(F.nullif(text(c), F.lit("")) for c in (statement, type_signature, name)), F.lit(""))
    body = F.regexp_replace(first, r"(?U)^[\s\x1c-\x1f]*\w+[\s\x1c-\x1f]+\w+[\s\x1c-\x1f]*:", "")
    body = F.lower(compact_ws(F.regexp_replace(body, r"(?U)\b[A-Z][0-9']?\b", "_")))
    return F.when(body != "", F.concat(text(library), F.lit("::"), body)).otherwise(F.concat(F.lit("name::"), text(name)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of the elements of both in those of either; 0 if one is empty."""
    n = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def signature_tokens(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit("[A-Za-z0-9_]+"), F.lit(0)))


def hash_sample(c: Column | str, fraction: float) -> Column:
    """whether a row with this value is picked; reproducible, in steps of 1 / 10000."""
    return hash_int(c).cast("long") % 10000 < int(fraction * 10000)


def hash_split_is_test(cluster: Column, fraction: float) -> Column:
    """whether a cluster is on the test side, in steps of 1 / 1000."""
    return hash_int(cluster).cast("long") % 1000 < int(fraction * 1000)


def module_head(module: Column | str, default: str = "") -> Column:
    """the first dotted component of a module path."""
    return F.substring_index(F.coalesce(F.nullif(text(module), F.lit("")), F.lit(default)), ".", 1)
