"""Codes, word lists, patterns and prompt wording.

They are data, not logic.  Anything here must keep its exact value, otherwise
stored answers, masks or scores made earlier would no longer line up.
"""

# Polarity codes in code order.
LABELS = ("positive", "negative", "neutral")

# Text of the aspect and the opinion when nothing was found.
NONE_ASPECT = "NONE"
NO_OPINION = "False"

# Accepted spellings of a boolean.
TRUE_WORDS = ("y", "yes", "t", "true", "on", "1")
FALSE_WORDS = ("n", "no", "f", "false", "off", "0")

# Modifiers and the marks they leave on the next plain token.
NEGATIONS = ("not", "no", "never", "neither", "hardly", "scarcely")
INTENSIFIERS = ("very", "extremely", "incredibly", "absolutely")
NEGATION_MARK = "NOT_"
INTENSIFIER_MARK = "INTENSIFIED_"

# Relations and word classes that make a token an aspect.
ASPECT_RELATIONS = ("nsubj", "dobj", "attr", "nmod")
PAIR_RELATIONS = ("nsubj", "dobj")
ASPECT_CLASS = "NOUN"
OPINION_CLASS = "ADJ"

# Sarcasm verdicts and the sentence score that conflicts.
SARCASM = "Potential Sarcasm detected"
NO_SARCASM = "No sarcasm detected"
SARCASM_LEVEL = 0.5

# Sizes.
LABELLING_BATCH = 10
EVALUATION_BATCH = 16
MAX_LENGTH = 300
RESERVED_WORDS = 25
VALIDATION_ROWS = 150
CONTEXT_WINDOW = 5
COMPOUND_ALPHA = 15.0

# Time format of exported comments and of stored rows.
EXPORT_TIME = "dd/MM/yyyy, HH:mm:ss"
STORED_TIME = "yyyy-MM-dd HH:mm:ss"

# Patterns (ours).  The blank class lists what Python's ``str.split`` cuts at.
WORD = r"(\p{L}+)"
WORD_OR_NUMBER = r"(\p{L}+|\p{N}+)"
SURFACE_TOKEN = r"([\p{L}]+(?:['’][\p{L}]+)*+|\p{N}+|[^\s\p{L}\p{N}])"
SENTENCE = r"([^.!?\n]+[.!?]?)"
BLANK = (
    r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# Markers a decoded model output may still carry.
SPECIAL_MARKERS = ("<pad>", "</s>")

# Wording of the single-sentence prompts.
CONTEXT_OPENING = 'Given the sentence "{context}", '
ASK_POLARITY = "what is the sentiment polarity towards {target}?"
ASK_POLARITY_MASKED = "the sentiment polarity towards {target} is [mask]"
ASK_ASPECT = "which specific aspect of {target} is possibly mentioned?"
ASK_OPINION = (
    " Based on the common sense, what is the implicit opinion towards the"
    " mentioned aspect of {target}, and why?"
)
ASK_POLARITY_OF_OPINION = (
    " Based on such opinion, what is the sentiment polarity towards {target}?"
)
ASK_TARGETS = "what are the target aspect terms being spoken about?"
ASK_OPINION_EXPRESSION = (
    "which specific opinion expression of the {target} is possibly mentioned?"
)
ASK_ASPECT_TERMS = "which words or phrases are the aspect terms?"

# How an answer is glued to the context, "framed" style.
FRAMED_ASPECT = " The mentioned aspect is about {answer}."
FRAMED_OPINION = (
    " The opinion towards the mentioned aspect of {target} is {answer}."
)
FRAMED_POLARITY = " The sentiment polarity is {answer}."
FRAMED_LABEL = (
    " Based on these contexts, summarize and return the sentiment polarity"
    " only, such as positive, neutral, or negative."
)
# Fixed value: label request, "chat" style.
CHAT_LABEL = (
    " Based on these contexts, summarize the sentiment polarity, and return"
    " only one of these words: positive, neutral, or negative."
)
CHAT_SYSTEM = "Now you are an expert of sentiment and opinion analysis."

# Wording of the batch prompts (spelling included).
BATCH_OPENING = 'Given these sentences "{sentences}", '
BATCH_PAIRS_OPENING = (
    'Given these sentences "{sentences}" and aspect term pairs"{aspects}"'
    " which are of length {n}, "
)
ASK_PAIR_LABELS = (
    "determine the polairty (positive, negative or neutral) of aspect term and"
    " if it is explicitely or implicitely expressed with respect to the whole"
    " sentence?"
)
SENTENCE_PAIR_OPENING = (
    'Given the sentence "{sentence}", and this/these aspect term(s),"{aspects}'
)

# Instructions to the model for the two batch requests, in our own words; the
# answer formats are the ones `functions.responses` reads.  Callers may pass
# their own text instead.
ASPECT_ROLE = (
    "For every sentence of the list name the words or phrases that carry a"
    " sentiment, openly or by implication: people, places, things and ideas."
    " Answer with nothing but a JSON array that has one object per sentence,"
    " in the same order, each with the key 'aspectTerm'. Its value is one term,"
    " a list of terms if there are several, or 'NONE' if there is none."
)
LABEL_ROLE = (
    "For every pair of sentence and aspect term decide the polarity, 0 for"
    " positive, 1 for negative, 2 for neutral, and whether it is implied"
    " ('True') or stated ('False'). Answer with nothing but a JSON array that"
    " has one object per pair, in the same order, with the keys 'polarity' and"
    " 'implicitness'. The aspect 'NONE' always has implicitness 'False'."
)

# Default stop words (ours): frequent function words of the four languages the
# corpora come in.  Every operator also takes a list or a table of the caller.
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it"
    " its not of on or she that the their they this to was we were which with"
    " you au aux avec ce dans de des du elle en et il la le les ou par pas pour"
    " que qui sur un une das dem den der die ein eine im ist mit nicht sich und"
    " von zu como con del el es lo los las no para por se su una y"
).split()

# Ours: stands in a record for a label that no answer gave.
NO_LABEL = "none"
