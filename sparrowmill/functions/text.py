"""Column builders over caption arrays and texts; none of them touches a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import standard_numbers

SPACES = r"(?U)\s+"
#: Spaces of any script (the separators Zs), as trimming takes them off; tabs and line ends stay.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def word_count(captions: Column) -> Column:
    return F.aggregate(captions, F.lit(0).cast("long"), lambda n, c: n + F.size(words(c)))


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def plain_text(captions: Column) -> Column:
    """Trimmed captions joined by spaces; blank captions leave their space."""
    # a function of two parameters would get the caption's number as the signs to trim
    return trimmed(F.array_join(F.transform(captions, lambda c: trimmed(c)), " "))


def caption_casing(caption: Column) -> Column:
    """mixed if blank or both cases, upper if only capitals, else lower (digits too)."""
    up, low = caption.rlike("[A-Z]"), caption.rlike("[a-z]")
    return F.when((trimmed(caption) == "") | (up & low), "mixed").when(up, "upper").otherwise("lower")


def casing_counts(captions: Column) -> Column:
    kinds = F.transform(captions, caption_casing)
    of = lambda name: F.size(F.filter(kinds, lambda k: k == name)).cast("long").alias(name)
    return F.struct(of("upper"), of("lower"), of("mixed"))


def casing(counts: Column) -> Column:
    """The commonest class; a class with over 0.6 as many mixed captions turns mixed; ties go to mixed, then upper."""
    u, l, m = counts["upper"], counts["lower"], counts["mixed"]
    top = F.greatest(u, l, m)
    n_top = (u == top).cast("int") + (l == top).cast("int") + (m == top).cast("int")
    return (
        F.when(n_top > 1, F.when(m == top, "mixed").when(u == top, "upper").otherwise("lower"))
        .when(m == top, "mixed")
        .when(l == top, F.when(m / l > 0.6, "mixed").otherwise("lower"))
        .otherwise(F.when(m / u > 0.6, "mixed").otherwise("upper"))
    )


def has_comma_period(captions: Column) -> Column:
    return F.exists(captions, lambda c: c.contains(",")) & F.exists(captions, lambda c: c.contains("."))


def repeating_lines(captions: Column) -> Column:
    """Whether a caption of two words or more stands inside the next one of two words or more."""
    n = F.size(captions)
    pairs = F.zip_with(F.slice(captions, 1, F.greatest(n - 1, F.lit(0))), F.slice(captions, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.exists(pairs, lambda p: (F.size(words(p.a)) > 1) & (F.size(words(p.b)) > 1) & p.b.contains(p.a))


def capital_after_stop(captions: Column) -> Column:
    """Whether every caption after one that ends a sentence starts with a capital, if it starts with a letter of any script."""
    n = F.greatest(F.size(captions) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(captions, 1, n), F.slice(captions, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return ~F.exists(pairs, lambda p: p.a.rlike(r"[.!?]\s*$") & p.b.rlike(r"^\s*\p{L}") & ~p.b.rlike(r"^\s*\p{Lu}"))


#: Speaker labels, and runs of entities and markers; each hit with the spaces around it becomes one space.
SPEAKER = r"[ ]*(?:[A-Z][a-zA-Z]*[ ])+:[ ]*"
MARKERS = r"[ ]*(?:&nbsp;|&amp;|&lt;|&gt;|=|\.{3}|\\h)+[ ]*"


def clean_caption(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPEAKER}|{MARKERS}", " ")


#: Spellings that dialect transcripts are relabelled to, and what is taken out of them.
RELABELLED = {"busses": "buses", "aks": "ask", "aksing": "asking", "aksed": "asked"}
TAKEN_OUT = (r"(?i)/unintelligible/", r"(?i)/inaudible/", r"/RD(.*?)/", r"/\?+/", r" ?<[^>]+>", r" ?\([^)]+\)", r" ?\{[^}]+\}")


def clean_dialect(text: Column) -> Column:
    """Dialect transcripts for scoring: brackets become braces, four words are relabelled, markers and remarks go with the space before them."""
    names = F.create_map(*(F.lit(x) for pair in RELABELLED.items() for x in pair))
    text = F.array_join(F.transform(words(F.translate(text, "[]", "{}")), lambda w: F.coalesce(names[w], w)), " ")
    for pattern in TAKEN_OUT:
        text = F.regexp_replace(text, pattern, "")
    return text


def machine_text(captions: Column, keep_first: bool) -> Column:
    """Text of rolling machine captions, which show each line twice: captions of one line, and the last line of the last caption.

    If the first two captions are equal, documents skip both and segments (``keep_first``) keep one of them.
    """
    n = F.size(captions)
    last_line = F.transform(captions, lambda c, i: F.when(i == n - 1, F.substring_index(c, "\n", -1)).otherwise(c))
    twice = F.coalesce((n > 1) & (F.get(captions, F.lit(0)) == F.get(captions, F.lit(1))), F.lit(False))
    gone = lambda i: twice & ((i == 1) if keep_first else (i < 2))
    return F.array_join(F.filter(last_line, lambda c, i: ~c.contains("\n") & ~gone(i)), " ")


#: Common words of a few languages (fixed lists); ties go to the language named first, a text without any of them is English.
COMMON_WORDS = {
    "en": "the of and to in is that it was for with on are this be by".split(),
    "fr": "le la les et des est une dans que pour qui sur pas au ce il".split(),
    "de": "der die und das ist nicht ein zu den mit von auf für im es dem".split(),
    "es": "el los las y que del por con una para como su al lo más es".split(),
}


def text_language(text: Column, common: dict[str, list[str]] = COMMON_WORDS, default: str = "en") -> Column:
    """The language whose common words the text has most of; ``default`` where it has none."""
    own = words(F.regexp_replace(F.lower(text), r"[^\p{L}']+", " "))

    def found(w: Column, listed: list[str]) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(listed)))

    def pick(w: Column) -> Column:
        scores = [F.struct(found(w, c).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, c) in enumerate(common.items())]
        best = F.array_max(F.array(*scores))
        return F.when(best["n"] > 0, best["name"]).otherwise(default)

    return F.coalesce(F.transform(F.array(own), pick)[0], F.lit(default))


#: What a decoder says where there is no speech (fixed values).
FILLER = r"^\s*(foreign you|foreign|Thank you for watching!|you there|you)\s*$"


def strip_foreign(text: Column) -> Column:
    return F.regexp_replace(text, r"\s*foreign\s*$", "")


def join_lines(text: Column) -> Column:
    """Line ends out, but for those before a time line."""
    return F.regexp_replace(text, r"\n(?!\d+\.\d+\s*-->)", "")


def cut_after_end(text: Column, end: str = "<|endoftext|>") -> Column:
    return F.when(text.contains(end), F.concat(F.substring_index(text, end, 1), F.lit(end))).otherwise(text)


def normalise(text: Column) -> Column:
    """Lower case, bracketed remarks and signs out, single spaces."""
    text = F.regexp_replace(F.lower(text), r"[<\[][^>\]]*[>\]]", "")
    text = F.regexp_replace(text, r"\([^)]+\)", "")
    text = F.regexp_replace(text, r"[^a-z0-9' ]", " ")
    return F.trim(F.regexp_replace(text, " +", " "))


#: Fixed values of the published English normalisation: fillers, contractions and short forms, in the order they are applied.
FILLERS = r"\b(hmm|mm|mhm|mmm|uh|um)\b"
SHORT_FORMS = (
    (r"\bwon't\b", "will not"), (r"\bcan't\b", "can not"), (r"\blet's\b", "let us"), (r"\bain't\b", "aint"), (r"\by'all\b", "you all"), (r"\bwanna\b", "want to"),
    (r"\bgotta\b", "got to"), (r"\bgonna\b", "going to"), (r"\bi'ma\b", "i am going to"), (r"\bimma\b", "i am going to"), (r"\bwoulda\b", "would have"), (r"\bcoulda\b", "could have"),
    (r"\bshoulda\b", "should have"), (r"\bma'am\b", "madam"), (r"\bmr\b", "mister "), (r"\bmrs\b", "missus "), (r"\bst\b", "saint "), (r"\bdr\b", "doctor "), (r"\bprof\b", "professor "),
    (r"\bcapt\b", "captain "), (r"\bgov\b", "governor "), (r"\bald\b", "alderman "), (r"\bgen\b", "general "), (r"\bsen\b", "senator "), (r"\brep\b", "representative "),
    (r"\bpres\b", "president "), (r"\brev\b", "reverend "), (r"\bhon\b", "honorable "), (r"\basst\b", "assistant "), (r"\bassoc\b", "associate "), (r"\blt\b", "lieutenant "),
    (r"\bcol\b", "colonel "), (r"\bjr\b", "junior "), (r"\bsr\b", "senior "), (r"\besq\b", "esquire "), (r"'d been\b", " had been"), (r"'s been\b", " has been"), (r"'d gone\b", " had gone"),
    (r"'s gone\b", " has gone"), (r"'d done\b", " had done"), (r"'s got\b", " has got"), (r"n't\b", " not"), (r"'re\b", " are"), (r"'s\b", " is"), (r"'d\b", " would"), (r"'ll\b", " will"),
    (r"'t\b", " not"), (r"'ve\b", " have"), (r"'m\b", " am"),
)


def normalise_english(text: Column, spellings: dict[str, str] | None = None, spoken_numbers: bool = True) -> Column:
    """The published English normalisation: remarks, fillers, short forms, signs, accents, spoken numbers, spaces.

    ``spellings`` maps whole words, as from British to American ones. Spoken numbers pass through Arrow; without them all
    steps are expressions.
    """
    text = F.regexp_replace(F.lower(text), r"[<\[][^>\]]*[>\]]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\(([^)]+?)\)", ""), FILLERS, "")
    text = F.regexp_replace(text, r"\s+'", "'")
    for pattern, by in SHORT_FORMS:
        text = F.regexp_replace(text, pattern, by)
    text = F.regexp_replace(F.regexp_replace(text, r"(\d),(\d)", "$1$2"), r"\.([^0-9]|$)", " $1")
    # accents go with their marks; signs but for those of numbers and money become spaces
    text = F.translate(text, "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}.%$¢€£\s]", " ")
    if spoken_numbers:
        text = standard_numbers(text)
    if spellings:
        names = F.create_map(*(F.lit(x) for pair in spellings.items() for x in pair))
        text = F.array_join(F.transform(words(text), lambda w: F.coalesce(names[w], w)), " ")
    text = F.regexp_replace(F.regexp_replace(text, r"[.$¢€£]([^0-9])", " $1"), r"([^0-9])%", "$1 ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


#: Folders and names of checkpoints (fixed values): what they say of a model.
MODEL_FOLDERS = {"ow_ckpts": "open", "yodas": "yodas", "owsm": "owsm"}
MODEL_SIZES = ("tiny", "small", "base", "medium", "large")


def model_kind(path: Column) -> Column:
    folder = F.try_element_at(F.split(path, "/"), F.lit(-3))
    return F.coalesce(F.create_map(*(F.lit(x) for pair in MODEL_FOLDERS.items() for x in pair))[folder], F.lit("other"))


def model_size(path: Column) -> Column:
    return F.coalesce(*(F.when(path.contains(s), s) for s in MODEL_SIZES), F.lit("unknown"))
