"""Word lists, patterns and lookup tables.

Two kinds live here. The lists under "Fixed values" decide results and must stay as they are for results to
compare; the lists under "Defaults" are ours and are meant to be replaced by the caller.
"""

# --------------------------------------------------------------------------------------------------------------
# Text normalisation
# --------------------------------------------------------------------------------------------------------------

NO_ENTRY = "no entry"

NULL_SPELLINGS = ["n/a", "na", "n.a", "n.a.", "null", "none", "nil"]

# The spellings a default CSV read turns into nulls.
CSV_NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --------------------------------------------------------------------------------------------------------------
# Dismissive answers
# --------------------------------------------------------------------------------------------------------------

NULL_LITERALS = ["nan", "none", "<na>", "nat"]

NULL_EXACT = [
    "no", "nope", "none", "null", "nil", "nothing", "nah",
    "no thanks", "no comment", "not really", "nothing extra",
    "nothing to add", "nothing else", "nothing more",
    "n/a", "na", "n.a", "n.a.", "nan",
    "yes", "yep", "yeah", "yup", "sure", "yes thanks",
    "ok", "okay", "fine", "good", "all good", "all is well",
    "everything is fine", "everythings fine",
    "as above", "see above", "same as above", "ditto",
    "as before", "see previous", "same",
    "i dont know", "i don't know", "dont know", "don't know",
    "unsure", "not sure", "no idea",
    "prefer not to say", "rather not say",
    "too private", "private", "personal",
    "dont want to share", "do not want to share",
]

# Matched against the whole stripped answer. {ws} stands for one whitespace character, {any} for all but a newline.
NULL_PATTERNS = [
    "no+",
    "yes+",
    "n/?a+",
    "none+",
    "nothing{ws}*(?:else|more|extra|to{ws}+add)?",
    "not?{ws}+really",
    "(?:as|see){ws}+(?:above|before|previous)",
    "all{ws}+(?:good|fine|ok|is{ws}+well)",
    "everything{any}*{ws}+(?:fine|good|ok)",
    "i{any}*m{ws}+(?:fine|good|ok)",
    "(?:i{ws}*)?(?:dont|don't|do{ws}+not){ws}+know",
    "unsure",
    "not{ws}+sure",
    "no{ws}+idea",
    "(?:too{ws}+)?private",
]

YES_RESPONSES = ["yes", "yep", "yeah", "yup", "sure", "yes thanks", "yes please", "yea"]

NO_RESPONSES = [
    "no", "nope", "nah",
    "n/a", "na", "n.a", "n.a.", "nan",
    "none", "null", "nil", "nothing",
    "nothing to add", "nothing else", "nothing more", "nothing extra",
    "no thanks", "no comment", "not really",
]

NO_SENTIMENT_RESPONSES = [
    "ok", "okay", "fine", "good", "all good", "all is well",
    "everything is fine", "everythings fine",
    "as above", "see above", "same as above", "ditto",
    "as before", "see previous", "same",
    "i dont know", "i don't know", "dont know", "don't know",
    "unsure", "not sure", "no idea",
    "prefer not to say", "rather not say",
    "too private", "private", "personal",
    "dont want to share", "do not want to share",
]

DISMISSIVE_SHORT = [
    "no", "n/a", "na", "none", "nothing", "nil", "nope",
    "yes", "yep", "yeah", "ok", "fine", "good",
    "as above", "see above", "same as above", "ditto",
    "no entry", "no comment", "no response",
]

# --------------------------------------------------------------------------------------------------------------
# Contrast, coping and negation
# --------------------------------------------------------------------------------------------------------------

CONTRAST_MARKERS = [
    "but", "however", "although", "though", "yet", "still", "nevertheless", "nonetheless", "while", "whereas",
    "despite", "in spite of", "on the other hand", "that said", "even so",
]

# A trailing * stands for any further word characters.
COPING_TERMS = [
    "exercise", "exercising", "gym", "fitness", "running", "walking", "swimming", "yoga", "working out",
    "physical activity",
    "talking to", "speak to", "spoke to", "sharing with", "family support", "friends", "colleagues", "team",
    "my manager", "line manager", "support from",
    "meditat*", "mindful*", "relax*", "breath*", "calm*", "deep breath",
    "time off", "holiday", "break", "leave", "vacation", "time away",
    "hobb*", "interests", "pursuing", "enjoying",
    "counseling", "counselling", "therapy", "therapist", "psychologist", "mental health support",
    "focusing on", "looking forward", "staying positive", "keeping perspective", "reminding myself",
]

NEGATION_TERMS = [
    "no", "not", "never", "can't", "cannot", "won't", "wouldn't", "don't", "doesn't", "hadn't", "hasn't", "haven't",
    "lack of", "without", "unable to", "failed to",
]

# --------------------------------------------------------------------------------------------------------------
# Phrase curation
# --------------------------------------------------------------------------------------------------------------

UK_SPELLINGS = {
    "organize": "organise", "organizing": "organising", "organized": "organised",
    "recognize": "recognise", "recognizing": "recognising", "recognized": "recognised",
    "prioritize": "prioritise", "prioritizing": "prioritising", "prioritized": "prioritised",
    "formalize": "formalise", "utilize": "utilise", "utilizing": "utilising", "utilized": "utilised",
    "behavior": "behaviour", "behavioral": "behavioural",
    "center": "centre", "meter": "metre", "odor": "odour", "labor": "labour",
    "color": "colour", "favor": "favour", "honor": "honour", "rumor": "rumour",
    "counseling": "counselling", "counselor": "counsellor",
    "traveling": "travelling", "canceled": "cancelled", "canceling": "cancelling",
    "modeling": "modelling", "program": "programme", "programs": "programmes",
}

# A trailing (s) marks an optional plural.
US_TO_UK_TERMS = {
    "pto": "annual leave",
    "paid time off": "annual leave",
    "vacation(s)": "annual leave",
    "sick day(s)": "sickness absence",
    "severance": "redundancy pay",
    "layoff(s)": "redundancy",
    "health insurance": "private medical cover",
    "open enrollment": "benefits enrolment",
    "performance review": "appraisal",
    "resume": "CV",
    "gas": "petrol",
    "cell phone": "mobile phone",
    "paid holiday(s)": "bank holidays",
    "doctor": "GP",
    "sick note": "fit note",
}

UK_WORKPLACE_VOCAB = [
    "annual leave", "bank holiday", "TOIL", "line manager", "rota", "shift pattern",
    "overtime", "on‑call", "handover", "stand‑up", "probation", "induction",
    "pay band", "pay grade", "cost of living", "redundancy", "redundancy pay",
    "TUPE", "appraisal", "capability process", "sickness absence", "fit note",
    "GP appointment", "occupational health", "union rep", "ACAS", "pension scheme",
    "mileage claim", "petrol expenses", "hot‑desking", "canteen", "annualised hours",
    "compressed hours", "flexitime", "carer's leave", "bereavement leave",
]

HARD_BAN = [
    "work is hard", "it is difficult", "things are bad", "please help",
    "help me", "very stressful", "so stressful", "need support", "need help",
    "things are tough", "struggling", "not good", "could be better",
    "more support needed", "better communication", "improve things",
]

GENERIC_LEADS = ["need", "want", "lack", "no", "more", "better", "improve"]

GENERIC_WORDS = ["need", "want", "more", "better", "improve", "help", "support"]

PHRASE_LIST_KEYS = ["data", "phrases", "items", "list"]

PHRASE_EDGE_CHARS = " .;:!?,"

# --------------------------------------------------------------------------------------------------------------
# Taxonomy files and word frequencies
# --------------------------------------------------------------------------------------------------------------

LIBRARY_COLUMNS = ["column", "parent", "theme", "subtheme", "polarity", "phrase"]

ALLOWED_POLARITY = ["positive", "negative", "neutral", "either"]

LIBRARY_SCHEMA_VERSION = "3.0"
LIBRARY_DESCRIPTION = "Column-specific theme libraries with strict enforcement"
LIBRARY_SOURCE = "theme_phrase_library.csv"

COLUMN_DESCRIPTIONS = {
    "Wellbeing_Details": "Primary response details",
    "Areas_Improve": "Suggestions for improvements",
    "Support_Provided": "Support mechanisms and resources available",
}

FREQUENCY_EXTRA_STOPWORDS = [
    "amp", "etc", "also", "still", "really", "maybe", "much", "many", "lot", "lots", "thing", "things", "everyone",
    "everything", "anything", "nothing", "could", "would", "should", "im", "ive", "dont", "didnt", "cant", "couldnt",
    "wouldnt", "thats", "wasnt", "isnt", "arent", "doesnt", "hadnt", "having", "get", "gets", "got", "going", "go",
]

# --------------------------------------------------------------------------------------------------------------
# Defaults: ours, replace them freely
# --------------------------------------------------------------------------------------------------------------

BASE_STOPWORDS = [
    "a", "about", "after", "again", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been",
    "before", "being", "but", "by", "can", "did", "do", "does", "for", "from", "had", "has", "have", "he", "her",
    "his", "how", "i", "if", "in", "into", "is", "it", "its", "just", "me", "more", "most", "my", "no", "nor", "not",
    "of", "on", "or", "our", "out", "over", "same", "she", "so", "some", "such", "than", "that", "the", "their",
    "them", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "us",
    "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "why", "will", "with", "you",
    "your",
]

POSITIVE_WORDS = [
    "cheap", "easy", "excellent", "fast", "friendly", "good", "great", "happy", "helped", "helpful", "kind", "love",
    "polite", "quick", "quickly", "reliable", "smooth", "supported", "thanks", "well",
]

NEGATIVE_WORDS = [
    "angry", "bad", "broken", "damaged", "difficult", "expensive", "failing", "hard", "high", "late", "long", "poor",
    "rude", "slow", "stressed", "terrible", "unhappy", "waiting", "worse", "wrong",
]

MODAL_WORDS = ["should", "could", "need", "must", "would", "might"]
HEDGE_WORDS = ["maybe", "perhaps", "possibly", "sort of", "kind of"]
INTENSIFIER_WORDS = ["very", "really", "extremely", "too", "so"]
NEGATION_WORDS = ["not", "no", "never", "cannot", "without"]
SUGGESTION_WORDS = ["improve", "better", "change", "more", "would like"]
FILLER_WORDS = ["nothing to add", "all good", "as above", "no comment", "n/a"]
