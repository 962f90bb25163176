"""Screening of texts: embedded instructions, and spans of personal data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of instructions in questions, in order, by name.
CHAT_PATTERNS = [
    ("ignore-previous", r"ignore (?:all )?previous instructions?"),
    ("olvida-anteriores", r"olvida\s+(?:(?:todas\s+)?(?:las\s+)?|mis\s+|estas\s+)?instrucciones?\s+anteriores?"),
    ("ignora-anteriores", r"ignora\s+(?:(?:todas\s+)?(?:las\s+)?|mis\s+|estas\s+)?instrucciones?\s+anteriores?"),
    ("fake-tag", r"</?(?:system|instructions?|prompt)>"),
    ("new-instructions", r"new instructions?:"),
    ("nuevas-instrucciones", r"nuevas instrucciones?:"),
    ("role-override-en", r"you are now (?:a |an )?"),
    ("role-override-es", r"ahora eres (?:un |una )?"),
    ("reveal-prompt", r"reveal (?:your |the )?(?:system )?prompt"),
    ("jailbreak-keyword", r"jailbreak|DAN"),
    ("fake-delimiter", r"###[\s_]*(?:end|fin)[\s_]*###"),
]
#: Patterns of instructions in documents, which go before those of questions.
DOCUMENT_PATTERNS = [
    ("document_instruction_to_evaluator", r"(?:el|la)\s+(?:asesor|asesora|analista|evaluador|evaluadora|revisor|revisora|sistema)\s+que\s+(?:eval[uú]e|revise|analice|consulte)\s+(?:esta|este)\s+(?:pol[ií]tica|documento|contrato|informe)\s+debe"),
    ("document_instruction_to_evaluator_direct", r"(?:el|la)\s+(?:asesor|asesora|analista|evaluador|evaluadora|revisor|revisora|sistema(?:\s+evaluador)?)\s+(?:debe|deber[íi]a|tiene\s+que)\s+(?:omitir|ignorar|saltarse|saltar|reportar|reportar\s+cumplimiento|concluir|confirmar)"),
    ("document_instruction_to_evaluator_en", r"the\s+(?:advisor|reviewer|analyst|evaluator|system)\s+(?:(?:reviewing|evaluating|analyzing|that\s+reviews)\s+this\s+(?:policy|document|contract|report)\s+)?(?:must|should|shall)\s+(?:conclude|state|respond|report|find|confirm)"),
    ("document_self_validating", r"esta\s+(?:pol[ií]tica|documento|contrato|informe)\s+cumple\s+plenamente\s+con"),
    ("document_citation_poisoning_es", r"los\s+art[ií]culos?\s+[\d\sy]+(?:que\s+aparecen)?\s+aqu[ií]?\s+son\s+interpretaciones\s+internas"),
    ("document_citation_poisoning_en", r"the\s+articles?\s+(?:cited|referenced|mentioned)\s+(?:here|above|below)?\s+are\s+internal\s+interpretations"),
    ("document_authorize_exception", r"se\s+autoriza\s+(?:expl[ií]citamente\s+)?la\s+excepci[oó]n\s+(?:del|al)?\s*art[ií]culo"),
    ("document_authorize_exception_en", r"(?:this\s+document\s+)?explicitly\s+authorizes?\s+the\s+exception\s+to"),
    ("document_meta_inject_es", r"(?:por\s+favor\s+)?ignora\s+(?:la\s+)?secci[oó]n\s+anterior"),
    ("document_meta_inject_en", r"(?:please\s+)?skip\s+the\s+previous\s+section"),
    ("document_role_override_es", r"act[uú]a\s+como\s+(?:un\s+)?abogado\s+(?:oficial|certificado)?"),
    ("document_role_override_en", r"act\s+as\s+a\s+lawyer\s+who\s+concludes"),
    ("document_data_exfiltration", r"env[ií]a\s+esta\s+informaci[oó]n\s+a\s+\S+@"),
    ("document_jailbreak_chain", r"(?:activate|enable)\s+DAN\s+mode|developer\s+mode\s+(?:on|enabled)"),
]
#: What a folded text must hold, any of them, for a pattern to match: cheaper to look for than the pattern.
NEEDS = {
    "ignore-previous": ["previous"], "olvida-anteriores": ["olvida"], "ignora-anteriores": ["ignora"], "fake-tag": ["<"], "new-instructions": ["new instruction"], "nuevas-instrucciones": ["nuevas instruccione"],
    "role-override-en": ["you are now"], "role-override-es": ["ahora eres"], "reveal-prompt": ["reveal "], "jailbreak-keyword": ["jailbreak", "dan"], "fake-delimiter": ["###"],
    "document_instruction_to_evaluator": ["debe"], "document_instruction_to_evaluator_direct": ["debe", "tiene"], "document_instruction_to_evaluator_en": ["advisor", "reviewer", "analyst", "evaluator", "system"],
    "document_self_validating": ["cumple"], "document_citation_poisoning_es": ["interpretaciones"], "document_citation_poisoning_en": ["interpretations"], "document_authorize_exception": ["autoriza"], "document_authorize_exception_en": ["explicitly"],
    "document_meta_inject_es": ["anterior"], "document_meta_inject_en": ["previous"], "document_role_override_es": ["abogado"], "document_role_override_en": ["lawyer"], "document_data_exfiltration": ["informaci"], "document_jailbreak_chain": ["mode"],
}
#: Kinds of personal data in order of precedence, their patterns and placeholders.
PII_PATTERNS = [
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL]"),
    ("iban", r"(?i)\bES\d{2}(?:[ ]?\d{4}){5}\b", "[IBAN]"),
    ("nie", r"(?i)\b[XYZ]\d{7}[A-Z]\b", "[NIE]"),
    ("dni_nif", r"(?i)\b\d{8}[A-Z]\b", "[DNI]"),
    ("card", r"\b(?:\d[ -]?){13,19}\b", "[TARJETA]"),
    ("phone", r"(?:(?:\+|00)34[ .\-]?)?\b[6-9]\d{2}[ .\-]?\d{3}[ .\-]?\d{3}\b", "[TELÉFONO]"),
]
_NONE = "cast(array() as array<struct<start:int,width:int,place:int,value:string>>)"


def injection(text: Column, mode: str = "chat") -> Column:
    """The name of the first pattern that occurs, null if none does. Case is ignored in all scripts."""
    patterns = [*(DOCUMENT_PATTERNS if mode == "document" else []), *CHAT_PATTERNS]
    # letters that a pattern takes for one another are one here: upper case before lower, and no dot above
    folded = F.transform(F.array(F.lower(F.upper(text))), lambda low: F.when(low.contains("\u0307"), F.translate(low, "\u0307", "")).otherwise(low))

    def first(low: Column) -> Column:
        may = lambda name: reduce(Column.__or__, [low.contains(w) for w in NEEDS[name]])
        return F.coalesce(*[F.when(may(name) & text.rlike(f"(?iuU){p}"), F.lit(name)) for name, p in patterns])

    return F.element_at(F.transform(folded, first), 1)


def matches(text: Column, pattern: str, place: int) -> Column:
    """array<struct<start (from 0), width, place, value>> of a pattern: what lies between matches gives where they are."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.transform(F.split(text, pattern), lambda g: F.length(g))

    def add(a: Column, p: Column) -> Column:
        start = a["at"] + p["gap"]
        one = F.struct(start.alias("start"), F.length(p["value"]).alias("width"), F.lit(place).alias("place"), p["value"].alias("value"))
        return F.struct((start + F.length(p["value"])).alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    pairs = F.arrays_zip(found.alias("value"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.expr(_NONE).alias("out")), add, lambda a: a["out"])


def pii_spans(text: Column) -> Column:
    """Non-overlapping spans of personal data by start: of overlapping ones the earlier stays, then the longer, then the kind listed first."""
    each = []
    for place, (kind, pattern, _) in enumerate(PII_PATTERNS):
        own = matches(text, f"(?U){pattern}", place)
        if kind == "card":
            bare = lambda m: F.regexp_replace(m["value"], r"[^0-9]", "")
            own = F.filter(own, lambda m: F.length(bare(m)).between(13, 19) & F.coalesce(F.call_function("luhn_check", bare(m)), F.lit(False)))
        hint = "@" if kind == "email" else "[0-9]"
        each.append(F.when(text.contains("@") if kind == "email" else text.rlike(hint), own).otherwise(F.expr(_NONE)))
    before = lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).when(x["width"] != y["width"], y["width"] - x["width"]).otherwise(x["place"] - y["place"])
    begin = F.struct(F.lit(-1).alias("end"), F.expr(_NONE).alias("out"))
    keep = lambda a, m: F.when(m["start"] >= a["end"], F.struct((m["start"] + m["width"]).alias("end"), F.concat(a["out"], F.array(m)).alias("out"))).otherwise(a)
    kept = F.aggregate(F.array_sort(F.concat(*each), before), begin, keep, lambda a: a["out"])
    kinds = F.array(*[F.lit(k) for k, *_ in PII_PATTERNS])
    return F.transform(kept, lambda m: F.struct(F.element_at(kinds, m["place"] + 1).alias("kind"), m["start"].alias("start"), (m["start"] + m["width"]).alias("end")))


def redact(text: Column, spans: Column) -> Column:
    """text with placeholders in place of its spans."""
    marks = F.create_map(*[F.lit(x) for k, _, mark in PII_PATTERNS for x in (k, mark)])
    cut = lambda a, b: F.substring(text, a + 1, b - a)
    add = lambda a, s: F.struct(F.concat(a["out"], cut(a["at"], s["start"]), F.element_at(marks, s["kind"])).alias("out"), s["end"].alias("at"))
    return F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), add, lambda a: F.concat(a["out"], cut(a["at"], F.length(text))))


def pii_counts(spans: Column) -> Column:
    """Occurrences by kind, in order of kinds; null if there are none."""
    kinds = sorted(k for k, *_ in PII_PATTERNS)
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), count(k).alias("value")) for k in kinds])
    return F.when(F.size(spans) > 0, F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0)))
