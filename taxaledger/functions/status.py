"""Status vocabularies: taxonomic classes, threat labels, audit wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (
    FLAG_CONFIRMED, FLAG_NEAR_ABSENT, FLAG_NO_DATA, FLAG_OUTSIDE, REPLACED_SOURCES,
)
from .text import _c, is_filled, match_key, trimmed


def _lookup(values: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in values.items() for v in pair])
    return F.element_at(table, key)


# --- checklist attributes -------------------------------------------------

# Origin vocabulary of the checklists and its Darwin Core term.
ESTABLISHMENT = {
    "native": "native", "naturalized": "introduced", "cultivated": "introduced",
    "introduced": "introduced", "uncertain": "uncertain",
}


def establishment_means(origin) -> Column:
    return _lookup(ESTABLISHMENT, F.lower(_c(origin)))


def endemism_remark(endemism) -> Column:
    e = _c(endemism)
    return F.when(e.isin("Endemic", "Non-endemic"), F.concat(F.lit("endemism="), e))


# --- resolution status ----------------------------------------------------

# Words in a raw status that make its name a synonym.
SYNONYM_WORDS = "synonym|misspell|misappl|invalid|unaccepted|provision"


def taxonomic_class(status) -> Column:
    """Raw taxonomic status as accepted, synonym or unresolved."""
    s = F.lower(_c(status))
    return (
        F.when(s == "accepted", "accepted")
        .when(s.rlike(SYNONYM_WORDS), "synonym")
        .otherwise("unresolved")
    )


def status_key(validation_status, taxonomic_status) -> Column:
    v = F.lower(_c(validation_status))
    s = F.when(v.isNull() | (v == ""), taxonomic_class(taxonomic_status)).otherwise(v)
    return (
        F.when(s == "unresolved", "ambiguous")
        .when(s.isin("accepted", "synonym", "ambiguous"), s)
        .otherwise("not_found")
    )


def status_rank(validation_status, taxonomic_status) -> Column:
    k = status_key(validation_status, taxonomic_status)
    return (
        F.when(k == "accepted", 4).when(k == "synonym", 3).when(k == "ambiguous", 2).otherwise(1)
    )


def checklist_status(spelling, taxonomic_status) -> Column:
    """Verdict of a national checklist: spelling of the match, then its status."""
    sp, ts = _c(spelling), _c(taxonomic_status)
    return (
        F.when(
            sp == "Correct",
            F.when(F.coalesce(F.contains(F.lower(ts), F.lit("synonym")), F.lit(False)), "synonym")
            .otherwise("accepted"),
        )
        .when(sp == "Probably_incorrect", "ambiguous")
        .otherwise("not_found")
    )


def backbone_status(status, match_type) -> Column:
    s, m = F.upper(_c(status)), F.upper(_c(match_type))
    return (
        F.when(F.coalesce(m == "NONE", F.lit(False)) | s.isNull() | (s == ""), "not_found")
        .when(s == "ACCEPTED", "accepted")
        .when(s == "SYNONYM", "synonym")
        .otherwise("ambiguous")
    )


# --- threatened-species list ----------------------------------------------

# Severity of a threat category; anything else is 0.
SEVERITY = {"CR (PEX)": 5, "CR": 4, "EN": 3, "VU": 2, "NT": 1}

# Labels of the threat categories in the output sheet.
STATUS_LABELS = {
    "EX": "(EX) Extinta",
    "EW": "(EW) Extinta na Natureza",
    "CR (PEX)": "(CR (PEX)) Criticamente Em Perigo (Possivelmente Extinta)",
    "CR": "(CR) Criticamente Em Perigo",
    "EN": "(EN) Em Perigo",
    "VU": "(VU) Vulneravel",
    "NT": "(NT) Quase Ameacada",
    "LC": "(LC) Pouco Preocupante",
}

# Red List categories whose assessment carries criteria.
CRITERIA_CATEGORIES = ("CR", "EN", "VU", "NT", "LR/nt", "LR/cd")

# Words that may stand between the word for the act, its number and its year.
ACT_WORD = "portaria"
ISSUER_WORDS = ("do", "gm", "mma")
NUMBER_WORDS = ("no", "n")


def severity(category) -> Column:
    return F.coalesce(_lookup(SEVERITY, _c(category)), F.lit(0))


def status_label(category) -> Column:
    code = F.regexp_replace(F.upper(trimmed(category)), r"\s+", " ")
    code = F.when(code == "CR(PEX)", "CR (PEX)").otherwise(code)
    return _lookup(STATUS_LABELS, code)


def federal_reference(source) -> Column:
    """``number/year`` of a value that is one federal reference, else null.

    The key's words are: the act, issuers in this order, each at most once, a
    word for "number", the number, maybe a date without its year, the year.
    """
    words = F.split(match_key(F.regexp_replace(_c(source), r"(\d)\.(\d)", "$1$2")), " ")
    number = lambda w: w.rlike("^[0-9]+$")

    def verdict(w: Column) -> Column:
        at = F.array_min(F.transform(w, lambda x, i: F.when(number(x), i)))
        lead, year = F.slice(w, 2, F.greatest(at - 1, F.lit(0))), F.element_at(w, -1)
        tail = F.slice(w, at + 2, F.greatest(F.size(w) - at - 2, F.lit(0)))
        numbered = F.coalesce(F.element_at(F.when(F.size(lead) > 0, lead), -1).isin(*NUMBER_WORDS), F.lit(False))
        issuers = F.when(numbered, F.slice(lead, 1, F.greatest(F.size(lead) - 1, F.lit(0)))).otherwise(lead)
        # Keeping the known words in their order gives the same list only if there are no others.
        known = F.filter(F.array(*map(F.lit, ISSUER_WORDS)), lambda k: F.array_contains(issuers, k))
        day = F.get(tail, F.lit(1))
        dated = (
            (F.get(tail, F.lit(0)) == "de") & number(day) & (F.length(day) <= 2) & (F.get(tail, F.lit(2)) == "de")
            & F.get(tail, F.lit(3)).rlike("^[a-z]+$")
        )
        left = F.when(F.coalesce(dated, F.lit(False)), F.slice(tail, 5, F.size(tail))).otherwise(tail)
        ends = (F.size(left) == 0) | ((F.size(left) == 1) & (F.get(left, F.lit(0)) == "de"))
        whole = (F.get(w, F.lit(0)) == ACT_WORD) & (issuers == known) & ends & number(year) & (F.length(year) == 4) & (F.size(w) - 1 > at)
        return F.when(F.coalesce(whole, F.lit(False)), F.concat_ws("/", F.get(w, at), year))

    return F.get(F.transform(F.array(words), verdict), F.lit(0))


def is_stale_source(source, replaced=REPLACED_SOURCES) -> Column:
    """Whether a status source is a replaced federal list; never null."""
    if not replaced:
        return F.lit(False)
    return F.coalesce(
        federal_reference(source).isin(*[r.replace(".", "") for r in replaced]), F.lit(False)
    )


def threat_code(status) -> Column:
    """Bare category code out of a label or a code: ``(CR (PEX)) ...`` is CR."""
    s = F.ltrim(F.regexp_replace(_c(status), r"\s", " "))
    shown = F.when(F.startswith(s, F.lit("(")) & F.contains(s, F.lit(")")), F.substring_index(F.substr(s, F.lit(2)), ")", 1)).otherwise(s)
    return F.substring_index(F.upper(F.trim(shown)), " ", 1)


# Threat level of a category; unknown codes read as ne.
THREAT_LEVELS = {
    "EX": "ex", "EW": "ex", "CR": "cr", "EN": "en", "VU": "vu",
    "NT": "nt", "LC": "lc", "DD": "dd", "NE": "ne",
}


def threat_level(status) -> Column:
    return F.coalesce(_lookup(THREAT_LEVELS, threat_code(status)), F.lit("ne"))


def is_threatened(status) -> Column:
    return threat_level(status).isin("vu", "en", "cr", "ex")


def kingdom_bucket(kingdom) -> Column:
    k = F.lower(trimmed(kingdom))
    return F.when(
        k != "", F.when(k.isin("animalia", "plantae", "fungi"), k).otherwise("other")
    )


# --- audit wording --------------------------------------------------------

def match_type(validation_status, query_name, final_name) -> Column:
    """Accepted splits into exact and corrected; the rest passes through."""
    v = _c(validation_status)
    changed = F.coalesce(match_key(final_name) != match_key(query_name), F.lit(False))
    return F.when(v == "accepted", F.when(changed, "corrected").otherwise("exact")).otherwise(v)


def decision_reason(validation_status, provider) -> Column:
    v = _c(validation_status)
    who = F.when(F.coalesce(_c(provider), F.lit("")) == "", "none").otherwise(_c(provider))
    return (
        F.when(v == "accepted", F.concat(F.lit("accepted_match_"), who))
        .when(v == "synonym", F.concat(F.lit("synonym_resolved_"), who))
        .when(v == "ambiguous", F.concat(F.lit("ambiguous_match_"), who))
        .when(v == "not_found", "not_found_kept_input")
    )


# How the results view words a resolution.
VALIDATION_LABELS = {
    "accepted": "aceito", "synonym": "sinônimo",
    "ambiguous": "ambíguo", "not_found": "não encontrado",
}
ALREADY_VALIDATED = "já validado"


def validation_label(validation_status) -> Column:
    return _lookup(VALIDATION_LABELS, _c(validation_status))


# --- distribution check ---------------------------------------------------

def dimension_match(area_values: Column, species_values: Column) -> Column:
    """Three-valued overlap: null when either side knows nothing."""
    return F.when(
        (F.size(area_values) > 0) & (F.size(species_values) > 0),
        F.arrays_overlap(area_values, species_values),
    )


def presence(state_match, biome_match) -> Column:
    """True when any known dimension matches, null when none is known."""
    s, b = _c(state_match), _c(biome_match)
    return F.when(s.isNull() & b.isNull(), F.lit(None).cast("boolean")).otherwise(
        F.coalesce(s, F.lit(False)) | F.coalesce(b, F.lit(False))
    )


def distribution_flag(has_record, present) -> Column:
    has, p = _c(has_record), _c(present)
    return (
        F.when(has, FLAG_CONFIRMED)
        .when(has.isNull() | p.isNull(), FLAG_NO_DATA)
        .when(p, FLAG_NEAR_ABSENT)
        .otherwise(FLAG_OUTSIDE)
    )


def is_prefilled(columns) -> Column:
    """A record is already validated when taxonID or kingdom is filled."""
    out = F.lit(False)
    for name in ("taxonID", "kingdom"):
        if name in columns:
            out = out | is_filled(name)
    return out
