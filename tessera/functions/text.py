"""Column functions that clean text fields, and the rules that read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and orders of the cohort's imaging metadata.
PHASE_PATTERNS = {
    "NC": (
        r"\bPRE[- ]?CONTRAST\b", r"\bUNENHANCED\b", r"\bNON[- ]?CONTRAST\b", r"\bNO CONTRAST\b", r"\bWITHOUT CONTRAST\b",
        r"(?<!W)\bW/O CONTRAST\b", r"(?<!W)\bWO CONTRAST\b", r"\bPRE LIVER\b", r"\bKIDNEYS PRE\b",
    ),
    "ART": (r"\bARTERIAL(?: PHASE)?\b", r"\bCORTICOMEDULLARY\b"),
    "NEPH": (r"\bNEPH(?:RO(?:GRAPHIC)?)?\b", r"\bPARENCHYMAL\b", r"\bPARANCHYMAL\b"),
    "DEL": (
        r"\bDELAY(?:ED)?\b", r"\bEXCRET(?:ION|ORY)?\b", r"\b(?:3|5|10|12|15)\s*MIN(?:UTE)?S?\b", r"\bDELAY BLADDER\b", r"\bKIDNEYS & DELAY\b",
    ),
}
CONTRAST_PATTERNS = (r"\bPOST[- ]?CONTRAST\b", r"\bWITH CONTRAST\b", r"\bW CONTRAST\b", r"\bVENOUS\b")
POST_TREATMENT = r"(?i)(?:\b(?:STATUS\s+POST|S/P|POST[- ]?(?:OPERATIVE|OP))\b[^\n]{0,80}\b(?:NEPHRECTOMY|RENAL\s+ABLATION)\b|\bPOST[- ]?NEPHRECTOMY\b)"
ANATOMY_REWRITES = (
    ("CTCHESTABDPEL|CHESTABDPEL", " CHEST ABD PEL "), ("CTCHEST", " CT CHEST "), ("CTCAP", " CT CAP "), (r"C\s*[/\-]\s*A\s*[/\-]\s*P", " CAP "), ("[^A-Z0-9]+", " "),
)
CHEST = r"\b(?:CHEST|THORAX|LUNG)\b"
ABDOMEN = r"\b(?:ABD|ABDOMEN|PELVIS|RENAL|KIDNEY|CAP)\b"
MULTIPHASE = (r"\bNC\b", r"\b(?:WC|WITH|CONTRAST|DELAY|ARTERIAL|NEPHRO)\b")
MISSING_TOKENS = ("", "UNKNOWN", "NA", "NX", "MX", "TX")


def safe_identifier(c: Column, default: str = "artifact") -> Column:
    """Letters, digits, '.', '_' and '-' stay; runs of other characters become '_'; an empty name the default."""
    safe = F.regexp_replace(F.trim(c), "[^a-zA-Z0-9._-]+", "_")
    return F.when(safe == "", default).otherwise(safe)


def anatomy(c: Column) -> Column:
    """Upper-case words of a series description, with run-together body parts taken apart."""
    x = F.upper(F.coalesce(c, F.lit("")))
    for pattern, text in ANATOMY_REWRITES:
        x = F.regexp_replace(x, pattern, text)
    return x


def chest_only(series: Column, fallback: Column) -> Column:
    """The series shows the chest and no part of the abdomen; without a series text the fallback is read."""
    own = anatomy(series)
    text = F.when(own == "", anatomy(fallback)).otherwise(own)
    return text.rlike(CHEST) & ~text.rlike(ABDOMEN)


def before_treatment(*fields: Column) -> Column:
    return ~F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]).rlike(POST_TREATMENT)


def _phases(text: Column) -> Column:
    """Phases of which a pattern is in the text, as an array."""
    hits = [F.when(text.rlike("|".join(patterns)), F.lit(phase)) for phase, patterns in PHASE_PATTERNS.items()]
    return F.array_compact(F.array(*hits))


def contrast_phase(series: Column, protocol: Column, agent: Column) -> Column:
    """struct(phase, source): the first rule that gives a phase. A text that names one phase alone gives it; a protocol of several
    phases says nothing, neither of a phase nor of contrast."""
    upper = {name: F.upper(F.coalesce(c, F.lit(""))) for name, c in (("series", series), ("protocol", protocol))}
    phases = {name: _phases(text) for name, text in upper.items()}
    told = {name: F.size(p) == 1 for name, p in phases.items()}
    single = ~(upper["protocol"].rlike(MULTIPHASE[0]) & upper["protocol"].rlike(MULTIPHASE[1]))
    contrast = F.concat_ws(" ", *upper.values()).rlike("|".join(CONTRAST_PATTERNS)) | (F.trim(F.coalesce(agent, F.lit(""))) != "")
    rules = [
        (told["series"], F.get(phases["series"], F.lit(0)), "series_description"),
        (told["protocol"] & single, F.get(phases["protocol"], F.lit(0)), "protocol_name"),
        (contrast & single, F.lit("CE_UNSPECIFIED"), "contrast_metadata"),
        (F.lit(True), F.lit("UNKNOWN"), "none"),
    ]
    return F.coalesce(*[F.when(rule, F.struct(phase.alias("phase"), F.lit(source).alias("source"))) for rule, phase, source in rules])


def order_key(c: Column) -> Column:
    """struct(rank, number, text) that sorts numbers first (colons ignored), then text, blanks before text."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    number = F.when(text != "", F.regexp_replace(text, ":", "").try_cast("double"))
    return F.struct(F.when(number.isNotNull(), 0).otherwise(1).alias("rank"), F.coalesce(number, F.lit(0.0)).alias("number"), F.when(number.isNull(), text).otherwise("").alias("text"))


def known(c: Column, missing: tuple[str, ...] = MISSING_TOKENS) -> Column:
    """The trimmed value, null if it is a token for a missing one."""
    text = F.trim(c)
    return F.when(~F.upper(text).isin(*missing), text)


def stage(c: Column) -> Column:
    """I to IV from a text such as 'Stage IIIA'; '' if there is none."""
    text = F.upper(F.coalesce(c, F.lit("")))
    out = F.lit("")
    for value in ("I", "II", "III", "IV"):  # the last test made is the first that counts
        out = F.when(text.contains(f"STAGE {value}") | (text == value), value).otherwise(out)
    return out


def tnm(c: Column, letter: str) -> Column:
    """'T2' and the like, from the first digit 1-4 after the letter; '' if there is none."""
    return F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), f"{letter}[1-4]", 0)


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in their order."""
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
