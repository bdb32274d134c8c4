"""Word lists, patterns and message texts that decide results.

Every value below is part of the specified behaviour and has to stay exactly as
it is.  Patterns are written so that Java's and RE2's dialects read them alike:
``W`` is a word character, ``S`` white space, ``D`` a digit, ``B0``/``B1`` stand
for a word boundary before/after in patterns that only ask "is it there".
"""

from __future__ import annotations

# --- character classes -------------------------------------------------------
WS_CLASS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
S = f"[{WS_CLASS}]"
NS = f"[^{WS_CLASS}]"
W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
D = r"\p{Nd}"
B0 = f"(?:^|{NW})"
B1 = rf"(?:{NW}|\z)"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- sizes and limits --------------------------------------------------------
CHUNK_SIZE = 512
CHUNK_OVERLAP = 64
TOP_K = 5
BM25_WEIGHT = 0.3
VECTOR_WEIGHT = 0.7
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
ALLOWED_SUFFIXES = (".pdf",)
MAX_FILE_MB = 50
MIN_CHARS_FOR_OCR = 100
MAX_PAGES_FOR_TABLES = 20
CACHE_TTL_SECONDS = 3600
LOW_RELEVANCE = 0.15

# --- cleaning ----------------------------------------------------------------
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
PAGE_NUMBER_ONLY = rf"(?:[-–—]?{S}*{D}{{1,4}}{S}*[-–—]?)"
PAGE_LABEL = rf"(?:(?i:page){S}+{D}+)"
SPACED_PAGE_LABEL = rf"(?:{D}+{S}*\|{S}*[Pp]{S}*[Aa]{S}*[Gg]{S}*[Ee])"
ROMAN_ONLY = r"(?:(?i:x{0,3}(?:ix|iv|v?i{0,3})))"
RULE_LINE = rf"(?:[.\-_{WS_CLASS}]{{3,}})"
REFERENCE_ITEM = rf"(?:\[{D}+\]{S}+)"
URL_ONLY = rf"(?:https?://{NS}+|www\.{NS}+)"
LEGAL_LINE = r"(?:(?i:copyright|©|all rights reserved|confidential|proprietary|draft))"
# a line is dropped when it is entirely one of these ...
WHOLE_LINE_NOISE = rf"^(?:{PAGE_NUMBER_ONLY}|{ROMAN_ONLY}|{RULE_LINE}|{URL_ONLY})\z"
# ... or starts with one of these
LINE_START_NOISE = rf"^(?:{PAGE_LABEL}|{SPACED_PAGE_LABEL}|{REFERENCE_ITEM}|{LEGAL_LINE})"
DOT_LEADER = r"\.{4,}"
CITATION_START = rf"^{D}{{1,2}}\.{S}+[A-Z][a-z]+"
CITATION_KEYWORDS = ("et al", "journal", "volume", "press", "doi", "isbn", "pp.", "vol.")
ABBREVIATION_DOT = r"(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|etc|vs|Fig|Eq)\."
DIGIT_DOT = rf"({D})\."

FAQ_METADATA = (
    rf"^(?:lecture{S}+notes?|prepared{S}+by|department{S}+of|college{S}+of|university)",
    r"^(?:module|unit|chapter|syllabus|references?|bibliography|acknowledgement)",
    rf"^(?:prof{B1}|dr\.?{S}|mr\.?{S}|mrs\.?{S}|ms\.?{S})",
    rf"^(?:page{S}+{D}|slide{S}+{D}|figure{S}+{D}|table{S}+{D})",
    rf"^(?:introduction{S}+to{S}+data|data{S}+structures?{S}+using)",
    rf"(?:all{S}+rights?{S}+reserved|copyright|ISBN)",
)
FAQ_GENERATOR_METADATA = (
    rf"^(?:lecture{S}+notes?|prepared{S}+by|department{S}+of|college{S}+of)",
    r"^(?:module|unit|chapter|syllabus|references?|bibliography)",
    rf"^(?:prof{B1}|dr\.?{S}|mr\.?{S})",
    rf"(?:all{S}+rights?{S}+reserved|copyright|ISBN)",
)
# replaced by one space, in this order
MATERIAL_NOISE = (
    r"(?i)\[/?TABLE\]",
    r"(?m)^[^\n|]*\|[^\n|]*\|[^\n]*",
    rf"{S}*\|{S}*",
    rf"\b{D}{{1,3}}{S}*/{S}*{D}{{2,3}}\b",
    r"[-=_]{3,}",
    rf"\b[A-Z]{{2,4}}{S}*{D}{{3,5}}\b",
    rf"\({D}-{D}-{D}\)",
)

# --- language detection ------------------------------------------------------
SCRIPT_RANGES = (
    ("hi", r"[\x{0900}-\x{097F}]"),
    ("ar", r"[\x{0600}-\x{06FF}]"),
    ("zh", r"[\x{4e00}-\x{9fff}]"),
    ("ja", r"[\x{3040}-\x{30ff}]"),
    ("ko", r"[\x{ac00}-\x{d7af}]"),
    ("ru", r"[\x{0400}-\x{04FF}]"),
    ("th", r"[\x{0e00}-\x{0e7f}]"),
)
FR_MARKERS = (
    "le la les une des est sont avec pour dans sur que qui pas nous vous leur mais comme tout bien "
    "aussi cette ces ont fait peut entre"
).split()
FR_FALSE = "la le des pour sur entre est".split()
ES_MARKERS = (
    "el los las una del por con como pero sin sobre entre hasta desde puede tiene hace todo esta cada muy "
    "donde cuando porque también otro fueron"
).split()
ES_FALSE = "el con como entre sin".split()
DE_MARKERS = (
    "der die das und ist ein eine den dem des auf mit sich nicht auch noch nach wird bei oder kann aber "
    "nur wenn als aus wie haben werden"
).split()
PT_MARKERS = (
    "uma são não com para mais pelo pela nos nas dos das quando mesmo ainda depois onde pode muito todos "
    "essa esse isso aqui então também"
).split()
PT_FALSE = "para com nos".split()
EN_MARKERS = (
    "the and is are was were have has been will would could should can do does did not but from they their "
    "which what when where how who this that these those there here each every some any other such than then "
    "only very also into through between after before because while being about"
).split()
FR_ACCENTS = "[àâäéèêëïîôùûüçœæ]"
DE_ACCENTS = "[äöüß]"
ES_ACCENTS = "[ñ¿¡]"
PT_ACCENTS = "[ãõç]"
LANGUAGE_NAMES = {
    "en": "English", "es": "Spanish", "fr": "French", "de": "German", "hi": "Hindi", "ar": "Arabic",
    "zh": "Chinese", "ja": "Japanese", "ko": "Korean", "ru": "Russian", "pt": "Portuguese", "it": "Italian",
    "th": "Thai", "nl": "Dutch", "sv": "Swedish",
}

# --- stop lists --------------------------------------------------------------
STUDY_STOP = (
    "the a an is are was were be been being have has had it its this that these those in on at of for to and or "
    "by with from but not can will which so as also such may would could should each than into about between "
    "after before through during our we their they then there here when where if how what more most some any "
    "all other only very just even still much"
).split()
ARTICLES = r"(?i)^(?:the|a|an)" + S + "+"
DETERMINERS = (
    r"(?i)^(?:such|this|that|these|those|it|its|they|their|our|we|some|any|each|every|most|many|few|several|"
    r"various|other)" + S + "+"
)
RELATED_STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might can shall "
    "of in to for with on at by from and or but not this that it its"
).split()
CONTEXT_STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might of in to "
    "and or for on at by with from this that these those what which how when where who why"
).split()
INSIGHT_STOP = (
    "the and for are was were been have has had does did will would could should from with this that which their "
    "there these those about into through during before after above also more most other some such than them "
    "then only very each when what where while being between both under over same because"
).split()
COMPARE_STOP = (
    "the and for are was were been have has had does did will would could should from with this that which their "
    "there these those about into through during before after also more most other some such than them then only "
    "very each when what where while being between both under over same because used using like just page figure"
).split()
RELATIONSHIP_STOP = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can "
    "need must of in to for with on at by from into through during before after between under above and or but "
    "not nor so yet both either this that these those it its their there which what who whom whose where when how "
    "each every all any some no more most other than then also such like just only very about over out up down "
    "off if because as while however although since until unless been being here come came make made well back "
    "even still way take taken many much used using use based one two new first may part see now get also set per "
    "end page figure table chapter section note ref"
).split()
QUESTION_MARKERS = (
    "important", "significant", "key", "main", "result", "conclusion", "finding", "method", "defined as",
    "refers to", "means",
)

# --- message texts -----------------------------------------------------------
MSG_NO_EXTRACT = "No relevant information found in the uploaded documents."
MSG_NO_HITS = (
    "I couldn't find any relevant information about this in your uploaded documents. "
    "This topic may not be covered in the current PDFs. Try rephrasing your question, "
    "or switch to **AI mode** for general knowledge answers."
)
MSG_NO_HITS_REASON = "No matching content retrieved from document store."
MSG_LOW_RELEVANCE = (
    "Your question doesn't appear to be covered in the uploaded documents. "
    "The search found very low relevance matches. You can try:\n"
    "- Rephrasing your question with keywords from the document\n"
    "- Switching to **AI mode** for general knowledge answers\n"
    "- Uploading additional documents that cover this topic"
)
MSG_TEACHER_HEAD = "**Key Points:**\n"
MSG_REFERENCES_HEAD = "\n\n**References:**"
MSG_FALLBACK_HEAD = "Based on the document content:\n\n"
MSG_FALLBACK_TAIL = (
    "\n\n*(Note: For richer AI-generated explanations, start Ollama locally — `ollama run llama3`)*"
)
MSG_FALLBACK_NONE = (
    "The AI answer mode works best when an Ollama model is running locally. "
    "Switch to **PDF mode** to get answers grounded in your uploaded documents, "
    "or start Ollama with: `ollama run llama3`"
)
MSG_AI_REASON = "Answer generated directly by AI without strict PDF grounding."
MSG_HIGH = "This answer is well-supported by your documents."
MSG_MEDIUM = "Consider verifying this answer with additional sources."
MSG_LOW = "This answer has limited support. Upload more relevant documents or rephrase your question."

ROLES = ("student", "teacher", "researcher", "admin")
PRIORITIES = ("low", "medium", "high")
TASK_STATUSES = ("todo", "in_progress", "done")

# --- study questions -----------------------------------------------------------
# A rule reads: pass number, pattern the sentence has to show (None: any), patterns whose
# first group is the subject, number of key terms used when no subject is found (None:
# no question then), question text, sentences of context after the first.
_ANY = r"[^\n]"
_LEAD = rf"(?i)^(?:The{S}+)?({_ANY}{{3,40}}?)"


def _verbs(*verbs: str) -> str:
    return rf"{_LEAD}{S}+(?:{'|'.join(verbs)}){B1}"


def _whole(*alternatives: str) -> str:
    return rf"(?i){B0}(?:{'|'.join(alternatives)}){B1}"


_DEFINED = (
    rf"(?i)^({_ANY}{{3,60}}?){S}+(?:is|are){S}+(?:a|an|the|one of){S}+({_ANY}{{15,}})",
    rf"(?i)^({_ANY}{{3,60}}?){S}+(?:refers? to|is defined as|means|is known as|is called){S}+({_ANY}{{15,}})",
)
_FEATURES = (
    rf"(?i)^({_ANY}{{3,50}}?){S}+(?:has|have|contains?|consists? of|includes?){S}+({_ANY}{{15,}})",
    rf"(?i)^({_ANY}{{3,50}}?){S}+(?:supports?|provides?|allows?|enables?){S}+({_ANY}{{15,}})",
)
_CARD_FEATURES = (
    _FEATURES[0],
    rf"(?i)^({_ANY}{{3,50}}?){S}+(?:supports?|provides?|allows?|enables?|requires?){S}+({_ANY}{{15,}})",
)
_COST = rf"O\([^)]+\)|(?i:{B0}(?:worst|average|best){S}+case{B1})"
_TYPES_OF = rf"(?i)types?{S}+of{S}+({_ANY}{{3,40}}?)(?:{S}*[:.,]|\z)"
_AGAINST = rf"(?i)(?:compared to|unlike|versus|difference between|similar to){S}+({_ANY}{{3,40}}?)(?:\.|,|\z)"
_EXAMPLE = rf"(?i){B0}(?:for example|for instance|such as|like){B1}|(?i:{B0}e\.g\.{W})"

FAQ_RULES = (
    (1, None, _DEFINED, None, "What is {}?", 2),
    (2, None, _FEATURES, None, "What are the key features of {}?", 2),
    (3, _COST, (_verbs("is", "has", "takes?"),), 3, "What is the time/space complexity of {}?", 2),
    (4, "(?i) compared to | unlike | versus | difference between | similar to ", (), 3, "How does {} compare?", 2),
    (5, _whole("advantage", "benefit", "strength", "efficient", "faster"),
     (_verbs("is", "are", "has", "have", "offers?"),), 3, "What are the advantages of {}?", 2),
    (5, _whole("disadvantage", "drawback", "limitation", "slow", "overhead"),
     (_verbs("is", "are", "has", "have", "offers?"),), 3, "What are the limitations of {}?", 2),
    (6, _whole("used (?:for|in|to)", "application", "commonly", "typically"),
     (_verbs("is", "are", "can"),), 3, "What are the applications of {}?", 2),
    (7, _whole("step", "first", "then", "procedure", "algorithm", "process"),
     (_verbs("is", "works", "involves", "begins"),), 4, "How does {} work?", 3),
    (8, _whole(f"types?{S}+of", f"kinds?{S}+of", "categor", "classified", "classification"), (_TYPES_OF,), 3,
     "What are the types of {}?", 2),
    (9, _EXAMPLE, (_verbs("is", "are", "has", "include", "can"),), 3, "What are examples of {}?", 2),
    (10, "(?i)because |in order to |so that |important |essential |crucial |necessary ",
     (_verbs("is", "are", "was", "exists?", "works?"),), 4, "Why is {} important?", 2),
    (11, None, (_verbs("is", "are", "was", "were", "has", "have", "can", "provides?"),), None, "Explain {} in detail.", 3),
)
CARD_RULES = (
    (1, None, _DEFINED, None, "What is {}?", 2),
    (2, None, _CARD_FEATURES, None, "What are the key features of {}?", 2),
    (3, _COST, (_verbs("is", "has", "have", "takes?", "requires?"),), 3, "What is the time/space complexity of {}?", 2),
    (4, "(?i) compared to | unlike | versus | difference between | similar to | in contrast ", (_AGAINST,), 4,
     "How do these compare: {} vs {}?", 2),
    (5, _whole("advantage", "benefit", "strength", "efficient"),
     (_verbs("has", "have", "is", "are", "offers?"),), 3, "What are the advantages of {}?", 2),
    (5, _whole("disadvantage", "drawback", "limitation", "slow", "overhead", "expensive"),
     (_verbs("has", "have", "is", "are", "offers?"),), 3, "What are the limitations of {}?", 2),
    (6, _whole("used (?:for|in|to|when)", "application", "commonly", "typically"),
     (rf"{_LEAD}{S}+(?:is|are|can be){S}+used{B1}", _verbs("is", "are")), 3, "What are the applications of {}?", 2),
    (7, _whole("step", "first", "then", "next", "finally", "process", "procedure", "algorithm"),
     (_verbs("is", "works", "involves", "begins", "starts", "requires"),), 4, "Describe the process of {}", 3),
    (8, "(?i)because |in order to |so that |reason |important because",
     (_verbs("is", "are", "was", "exists?", "works?"),), 4, "Why is {} important?", 2),
    (9, None, (_verbs("is", "are", "was", "were", "has", "have", "can", "will", "provides?"),), None, "Explain: {}", 2),
)

# --- exports: style sheet of the HTML form ---------------------------------------
HTML_STYLE = (
    "body { font-family: system-ui; max-width: 800px; margin: 40px auto; padding: 0 20px; background: #f9fafb; }\n"
    ".msg { margin: 16px 0; padding: 16px; border-radius: 12px; }\n"
    ".user { background: #4f46e5; color: white; margin-left: 60px; }\n"
    ".assistant { background: white; border: 1px solid #e5e7eb; margin-right: 60px; }\n"
    "h1 { color: #1f2937; } .meta { color: #9ca3af; font-size: 12px; margin-top: 8px; }\n"
)
