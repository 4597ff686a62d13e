"""Word lists the text functions depend on.  Fixed values: results depend on every entry."""

CONTRACTIONS = {
    "whats": "what is", "what's": "what is", "whatre": "what are", "what're": "what are", "what've": "what have", "whos": "who is", "who's": "who is", "who're": "who are",
    "hows": "how is", "how's": "how is", "whys": "why is", "why's": "why is", "whens": "when is", "when's": "when is", "wheres": "where is", "where's": "where is",
    "its": "it is", "it's": "it is", "thats": "that is", "that's": "that is", "theres": "there is", "there's": "there is", "dont": "do not", "don't": "do not",
    "doesnt": "does not", "doesn't": "does not", "cant": "cannot", "can't": "cannot", "couldnt": "could not", "couldn't": "could not", "wouldnt": "would not", "wouldn't": "would not",
    "shouldnt": "should not", "shouldn't": "should not", "wont": "will not", "won't": "will not", "isnt": "is not", "isn't": "is not", "arent": "are not", "aren't": "are not",
    "wasnt": "was not", "wasn't": "was not", "werent": "were not", "weren't": "were not", "mustnt": "must not", "mustn't": "must not", "im": "i am", "i'm": "i am",
    "ive": "i have", "i've": "i have", "youre": "you are", "you're": "you are", "youve": "you have", "you've": "you have", "we're": "we are", "theyre": "they are", "they're": "they are",
    "lets": "let us", "let's": "let us", "gonna": "going to", "wanna": "want to", "gotta": "got to", "kinda": "kind of", "lemme": "let me", "gimme": "give me", "whatis": "what is",
}

QUESTION_STARTERS = (
    "what how why when where who which whose is are do does did can could will would should may might must tell list show give provide need explain define describe max min maximum minimum"
).split()

RELEVANCE_STOP = (
    "a an the and or of for to with by in at on it its you your me my we us our them their they is are was were have has had do does did can could will would should may might must i that this these those which who whom whose"
).split()

NOISE_WORDS = "help please hi hey hello ok okay thanks thank urgent asap".split()
INFO_VERBS = "tell list show give provide".split()
INFO_NOUNS = (
    "documents document requirements requirement programs program ratio ratios score scores rates rate guidelines rules rule limits limit process steps eligibility criteria checklist forms form timeline timelines"
).split()

#: Keywords of each intent, in order of precedence.
INTENTS = {
    "costs": ["rate", "rates", "cost", "costs", "fee", "fees", "apr", "pmi", "mip", "premium", "insurance", "price"],
    "limits": ["max", "min", "maximum", "minimum", "limit", "limits", "threshold", "cap", "high", "low"],
    "documents": ["document", "documents", "paperwork", "forms", "form", "checklist", "what do i need"],
    "eligibility": ["eligible", "eligibility", "qualify", "qualification", "can i", "allowed"],
    "requirements": ["require", "requires", "required", "requirement", "requirements", "need", "needed", "must"],
    "process": ["process", "steps", "step", "how to", "how do", "procedure", "timeline", "how long"],
    "definition": ["what is", "what are", "define", "meaning", "explain"],
}

#: (suffix, what may take its place)
STEM_SUFFIXES = [
    ("ies", ["y"]), ("tion", ["", "e"]), ("ment", [""]), ("ant", ["", "at"]), ("ent", ["", "et"]), ("es", [""]), ("ing", ["", "e"]), ("ed", ["", "e"]), ("er", [""]), ("or", [""]), ("s", [""]),
]

#: Wordings that make a question complex.
COMPLEX_MARKERS = ["compare", "comparison", "difference", "different", "versus", " vs ", "why", "explain", "trade-off", "tradeoff", "pros and cons", "which is better", "walk me through", "step by step", "impact of"]

#: Keyword -> document type, in order.
DOC_TYPE_KEYWORDS = [
    ("underwriting", "underwriting"), ("eligibility", "eligibility"), ("compliance", "compliance"), ("policy", "policy"), ("procedure", "procedure"), ("guideline", "policy"), ("requirement", "policy"),
]

CONNECTIVES = "to of the for and a an in on with at by from or into over between".split()

#: Patterns of the question classes that no document can answer.
PERSONAL_DATA = r"(?i)\bmy\s+(?:account(?:\s+balance)?|balance|credit\s+score|(?:loan|application|approval)\s+status|loan\s+(?:file|case)|application|payment\s+history|case\s+status|file\s+status)\b|\bstatus\s+of\s+my\b"
FRAUD_VERB = r"(?i)\b(?:forge|forging|fake|faking|falsify|falsifying|fabricate|fabricating|doctor|doctoring|counterfeit|misrepresent|misrepresenting|conceal|concealing|hide|hiding|lie\s+(?:about|on|to))\b"
FRAUD_TARGET = r"(?i)\b(?:pay\s?stub|income|tax\s+return|bank\s+statement|w-?2|1099|credit\s+score|application|employment|debt|asset|down\s?payment)\b"
