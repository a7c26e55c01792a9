"""Clinical text as Column functions (CL2-CL14, CL23, CL26). Patterns stay within what Java and RE2 share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for missing, events and censoring.
MISSING = (
    "", "na", "n/a", "n.a.", "#na", "#n/a", "null", "nan", "-", "--", "—", "–", ".", "..", "?", "??", "unknown", "unk", "99 unk", "not available", "not reported",
    "not specified", "not applicable", "missing", "none", "non-applicable", "[unknown]", "[discrepancy]", "[not available]", "<na>",
)
EVENT = ("dead", "deceased", "d", "yes", "y", "relapse", "relapsed", "metastasis", "1", "death", "event", "recurrence", "recurred", "dead of disease", "true", "t")
CENSORED = ("alive", "live", "no", "a", "n", "0", "not relapsed", "survival", "censor", "censored", "no event", "no death", "no recurrence", "alive/no death", "false", "f")
#: Grade words.
GRADES = {
    "G1": ("1", "I", "G1", "WELL", "WELL DIFFERENTIATED"),
    "G2": ("2", "II", "G2", "MODERATELY", "MOD", "MODERATE", "MODERATELY DIFFERENTIATED", "LOW", "LOW GRADE", "LOW.GRADE"),
    "G3": ("3", "III", "G3", "POORLY", "POOR", "POORLY DIFFERENTIATED", "HIGH", "HIGH GRADE", "HIGH.GRADE"),
    "G4": ("4", "IV", "G4", "UNDIFFERENTIATED"),
}


def squeezed(c: Column) -> Column:
    """CL9: white space squeezed, missing words null."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(~F.lower(t).isin(*MISSING) & ~F.lower(t).rlike("^[# ]*n/?a[# ]*$"), t)


def status(c: Column, invert: bool = False, na_censor: bool = False) -> Column:
    """CL4: status text to 1 (event) or 0; inverted for censoring flags; blanks count as censored with na_censor."""
    t = F.lower(squeezed(c))
    negative = t.rlike("(non|no|not|without|free)[ -]*(of )?[ -]*(recur|relap|progress|metasta|event|disease)")
    out = F.when(t.isin(*CENSORED) | negative, 0).when(t.isin(*EVENT) | t.rlike("recur|relap|progress|metasta|dead|deceas|died"), 1).when(t.rlike("alive|living|censor"), 0)
    out = 1 - out if invert else out
    return F.when(t.isNull(), 0).otherwise(out) if na_censor else out


def status_12(c: Column) -> Column:
    """CL4: 1 censored, 2 event."""
    n = c.try_cast("double")
    return F.when(n == 1, 0).when(n == 2, 1)


def number(c: Column) -> Column:
    """CL7: the first number in a text. A decimal comma counts where the text is nothing else; spaces between thousands go."""
    t = F.trim(c)
    t = F.when(t.rlike("^[+-]?[0-9]+,[0-9]{1,2}$"), F.replace(t, F.lit(","), F.lit("."))).otherwise(t)
    t = F.regexp_replace(t, r"(?<=[0-9])[ \u00a0](?=[0-9]{3}([^0-9]|$))", "")
    return F.regexp_extract(t, r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", 0).try_cast("double")


def years(value: Column, unit: Column | str, day: float = 365.25) -> Column:
    """CL5: time to years; negative times count as 0. ``day`` is 365 where the source says so."""
    u = F.lower(F.lit(unit) if isinstance(unit, str) else unit)
    v = F.greatest(value, F.lit(0.0))
    return F.when(value.isNull(), None).when(u.startswith("d"), v / F.lit(day)).when(u.startswith("w"), v / F.lit(52.1786)).when(u.startswith("m"), v / F.lit(12.0)).when(u.startswith("y"), v)


def months_between_dates(start: Column, end: Column) -> Column:
    """CL6: days between two dates over 30.4375."""
    return F.datediff(F.to_date(end), F.to_date(start)).cast("double") / F.lit(30.4375)


def event_years(start: Column, event: Column, last: Column, state: Column) -> Column:
    """CL6: years to the event date of events, else to the last date."""
    return months_between_dates(start, F.when(state == 1, event).otherwise(last)) / F.lit(12.0)


def age_mid(c: Column) -> Column:
    """CL8: middle of the leading whole number and the end of a bin; a text without a bin must be a number as a whole."""
    t = F.trim(c)
    low = F.coalesce(F.nullif(F.regexp_extract(t, r"^([0-9]+)", 1), F.lit("")), t).try_cast("double")
    high = F.coalesce(F.nullif(F.regexp_extract(t, r"^[0-9]+-([0-9]+)$", 1), F.lit("")), t).try_cast("double")
    return (low + high) / 2


def stage(c: Column) -> Column:
    """CL10: 0, I, II, III or IV without sub-stage; TNM and descriptive texts are null."""
    t = F.regexp_replace(F.upper(F.coalesce(squeezed(c), F.lit(""))), r"^STAGE\s*", "")
    r = F.regexp_extract(t, r"^([0-4]|IV|III|II|I)[ABC]?$", 1)
    return F.when(r == "1", "I").when(r == "2", "II").when(r == "3", "III").when(r == "4", "IV").when(r != "", r)


def tnm(c: Column, prefix: str) -> Column:
    """CL11: T, N or M category without p/c prefix and a/b/c suffix; Tis and bare values are read."""
    t = F.upper(F.coalesce(squeezed(c), F.lit("")))
    values = {"T": "[0-4X]", "N": "[0-3X]", "M": "[01X]"}[prefix]
    named = F.regexp_extract(t, f"^[PC]?{prefix}({values}{'|IS' if prefix == 'T' else ''})[ABC]?$", 1)
    r = F.when(named != "", named).otherwise(F.regexp_extract(t, f"^({values})$", 1))
    return F.when(r == "IS", "Tis").when(r != "", F.concat(F.lit(prefix), r))


def tnm_parts(c: Column) -> list[Column]:
    """CL12: T, N and M of a combined text, the first of each letter."""
    found = F.regexp_extract_all(F.upper(F.trim(c)), F.lit(r"[PC]?[TNM](?:IS|[0-9]+|X)[A-C]?(?=[\s/,;_-]|[TNM]|[PC]|$)"), F.lit(0))
    first = lambda p: F.get(F.filter(found, lambda x: x.rlike(f"^[PC]?{p}")), 0)
    return [tnm(first(p), p).alias(p.lower() + "_part") for p in "TNM"]


def sex(c: Column) -> Column:
    """CL13."""
    t = F.lower(F.coalesce(squeezed(c), F.lit("")))
    return F.when(t.isin("male", "m", "man", "men"), "male").when(t.isin("female", "f", "woman", "women"), "female")


def grade(c: Column) -> Column:
    """CL13: G1 to G4 from digits, words or roman numbers; G0 to G9 and scores of 5 to 10 stay; others are null."""
    t = F.upper(F.coalesce(squeezed(c), F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for value, words in GRADES.items():
        out = out.when(t.isin(*words), value)
    return out.when(t.rlike("^(G[0-9]|[5-9]|10)$"), t)


def flag(c: Column) -> Column:
    """CL13: positive and negative words to 1 and 0, as text."""
    t = F.upper(F.trim(c))
    return F.when(t.isin("P", "POS", "POSITIVE", "+", "1"), "1").when(t.isin("N", "NEG", "NEGATIVE", "-", "0"), "0")


def flag_in(c: Column) -> Column:
    """CL13: texts that hold pos or neg to 1 and 0, as text."""
    t = F.lower(c)
    return F.when(t.contains("pos"), "1").when(t.contains("neg"), "0")


def mutation(c: Column) -> Column:
    """CL13: WT for wild type, M for any other text; blanks and NA are null."""
    t = F.trim(c)
    return F.when(t.isin("", "NA", "N/A") | t.isNull(), None).when(t.isin("WT", "wt"), "WT").otherwise("M")


def first_filled(*cols: Column) -> Column:
    """CL14: the first column that is not missing."""
    return F.coalesce(*map(squeezed, cols))


#: Cancer types by title words, in order.
CANCERS = (
    ("gliom|astrocyt|oligodendro|gbm|brain|medulloblast|meningioma|ependymom", "Glioma/Brain"),
    ("breast|mammary|brca", "Breast"),
    ("lung|pulmonary|nsclc|luad|lusc", "Lung"),
    ("colorect|colon|rectal|rectum", "Colorectal"),
    ("gastric|stomach|esophag|oesophag|barrett", "Gastric/Esophageal"),
    ("hepatocell|liver|hcc|cholangiocarcin", "Liver"),
    ("pancrea", "Pancreatic"),
    ("leukemi|leukem|aml|cml|myelodysplas|myeloid", "Leukemia"),
    ("lymphoma|myeloma|hodgkin|dlbcl|follicular lymph", "Lymphoma/Myeloma"),
    ("melanoma|cutaneous", "Melanoma/Skin"),
    ("renal|kidney|nephro|wilms", "Renal/Kidney"),
    ("bladder|urothelial|transitional cell", "Bladder/Urothelial"),
    ("ovarian|ovary", "Ovarian"),
    ("endometri|uterine|uterus|cervix|cervical", "Endometrial/Cervical/Uterine"),
    ("prostate", "Prostate"),
    ("head and neck|oral|tongue|larynx|pharyn|hnscc", "Head and Neck"),
    ("sarcoma|osteosarc|bone|ewing|liposarc", "Sarcoma/Bone"),
    ("thyroid", "Thyroid"),
    ("neuroblast|retinoblast|pheochrom|paragangliom|adrenocortical|mesothelio|testicular|germ cell|thymoma|gastroenteropancreatic|neuroendocrine", "Neuroendocrine/Other"),
)


def cancer_of(title: Column) -> Column:
    """CL26: type from the first pattern that a title has, else unknown."""
    t = F.lower(title)
    out = F.when(F.lit(False), F.lit(""))
    for pattern, kind in CANCERS:
        out = out.when(t.rlike(pattern), kind)
    return out.otherwise("unknown")


#: Keys of survival columns, in order.
KEY_TOKENS = (
    ("(^|[^a-z])(dss|css|bcss)([^a-z]|$)|disease[ _-]?specific|disease[ _-]?related|cause[ _-]?specific", "DSS"),
    ("(^|[^a-z])(dfs|dfi|efs)([^a-z]|$)|disease[ _-]?free", "DFS"),
    ("(^|[^a-z])(rfs)([^a-z]|$)|recurrence[ _-]?free|relapse[ _-]?free|recurrence|relaps|recur", "RFS"),
    ("(^|[^a-z])(pfs|pfi)([^a-z]|$)|progression[ _-]?free|progress", "PFS"),
    ("(^|[^a-z])(mfs|drfs)([^a-z]|$)|metasta|distant[ _-]?recurrence", "MFS"),
    ("(^|[^a-z])(os)([^a-z]|$)|overall[ _-]?survival|survival|surv|vital|death|dead|died|die|surtim|surind", "OS"),
)


def token_of_key(key: Column) -> Column:
    """CL23: endpoint token of a header key."""
    t = F.lower(key)
    out = F.when(F.lit(False), F.lit(""))
    for pattern, token in KEY_TOKENS:
        out = out.when(t.rlike(pattern), token)
    return out


#: Keys that never hold survival, words of time and event keys, generic keys that may pair with any endpoint.
EXCLUDED_KEY = (
    "age|braf|margin|residual|menopause|race|ethnic|smok|hpv|histolog|diagnos|\\bdx\\b|pathologic|birth|surgery|operation|treat|therap|drug|dose|"
    "batch|plate|scan|center|institut|country|gender|^sex|height|weight|stage|grade|site|tumor[ _-]?status|tissue|cell|culture|passage|protocol|keyword|date|"
    "group|subgrp|cluster|class|subtype|response|responder|censor[ _-]?reason|sample[ _-]?id|record[ _-]?id|patient[ _-]?id|^id$|number|prior[ _-]?lines"
)
TIME_KEY = "time|month|year|day|follow"
EVENT_KEY = "event|status|vital|death|dead|died|die|recur|relaps|progress|indicator|surv|outcome|censor|metasta"
GENERIC_TIME = (
    "surv|follow|vital|surtim|overall|disease|recur|relaps|progress|metasta|dfs|rfs|pfs|dss|(^|[^a-z])os([^a-z]|$)|^(time|months|years|days|follow[ _-]?up)(\\s*\\(.*\\))?$|"
    "(^|[^a-z])(futime|ftime|months?|years?|days?|fu|last[ _-]?fu|follow[ _-]?up)([^a-z]|$)"
)
GENERIC_EVENT = "surv|vital|death|dead|die|recur|relaps|progress|event|censor|follow|^(status|event|indicator)$|(^|[^a-z])(fustat|stat|fu[ _-]?stat|dead|died)([^a-z]|$)"
#: Texts for missing, no event, event; state and time in one text; longest text that is read as an event.
NO_VALUE = "^(na|n/?a|unknown|not available|not applicable|no more data|none|null|nd|--?|-|\\?|not determined|undetermined|not done|missing|no data)$"
NO_EVENT = (
    "alive|^no\\b|^n$|^false|negative|free of|no evidence|not recur|not progress|did not|without|^0$|no relapse|no recurrence|no progression|no death|ned|tumor free|"
    "^non[ _-]?(recur|relaps|progress|event)"
)
AN_EVENT = "dead|death|deceased|died|^yes|^y$|^true|positive|recur|relaps|progress|event|^1$|recurrence|metasta|decease"
STATE_AND_TIME = "(alive|dead|deceased|died|no evidence of disease|ned|recurrence|relapse|recurred|relapsed|progression|progressed|metastasis|metastatic)[^0-9]{0,30}?([0-9]+(\\.[0-9]+)?)\\s*(months?|years?|days?|weeks?)"
#: Fixed value: words in a key that hint at survival.
SURVIVAL_HINT = "(surv|follow|vital|death|dead|die|died|recur|relaps|progress|event|status|indicator|month|year|day|dfs|rfs|pfs|dss|mfs|\\bos\\b|surtim|surind|outcome|metasta|futime|fu[ _-]?stat)"
LONGEST_EVENT = 40


def unquoted(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), '^"|"$', ""))


def event_of(value: Column) -> Column:
    """CL23: 1, 0 or null of a value of an event key; texts without an event come first, numbers must be 0 or 1."""
    t = F.lower(unquoted(value))
    n = t.try_cast("double")
    return F.when((t == "") | t.rlike(NO_VALUE), None).when(t.rlike("^-?[0-9.]+$"), F.when(n.isin(0, 1), n)).when(t.rlike(NO_EVENT), 0.0).when(t.rlike(AN_EVENT), 1.0)


def time_of(value: Column) -> Column:
    """CL23: the first number of a value of a time key."""
    return F.regexp_extract(unquoted(value), r"[-+]?[0-9]*\.?[0-9]+", 0).try_cast("double")


def survival_values(key: Column, value: Column) -> list[Column]:
    """CL23: what a key/value cell gives as time and as event.

    Keys with only time words give times, with only event words events, others both if the value can be read so. A key of
    no endpoint must be a generic one for the role; remarks in brackets do not count for that. Excluded keys give nothing.
    """
    k = F.lower(key)
    bare = F.regexp_replace(k, r"\([^)]*\)", " ")
    timely, eventful, named = k.rlike(TIME_KEY), k.rlike(EVENT_KEY), token_of_key(key).isNotNull()
    ok = ~k.rlike(EXCLUDED_KEY)
    time = F.when(ok & (timely | ~eventful) & (named | bare.rlike(GENERIC_TIME)), time_of(value))
    event = F.when(ok & (eventful | ~timely) & (named | bare.rlike(GENERIC_EVENT)) & (F.length(value) <= LONGEST_EVENT), event_of(value))
    return [time.alias("time"), event.alias("event")]


def combined(value: Column) -> list[Column]:
    """CL23: state, time, unit and endpoint of texts such as "Deceased after 27 months"."""
    t = F.lower(unquoted(value))
    word, n, units = (F.regexp_extract(t, STATE_AND_TIME, k) for k in (1, 2, 4))
    unit = F.regexp_replace(units, "s$", "")
    token = F.when(word == "", None).when(word.rlike("recur|relaps"), "RFS").when(word.rlike("progress"), "PFS").when(word.rlike("metasta"), "MFS").otherwise("OS")
    return [F.when(word != "", F.when(word.rlike("alive|no evidence|ned"), 0).otherwise(1)).alias("state"), n.try_cast("double").alias("time"), F.nullif(unit, F.lit("")).alias("unit"), token.alias("token")]
