"""Fixed values.

Every list, phrase and template in this module must equal the tutoring
rules this engine reproduces, character for character and in the same
order: the order of a list is part of its meaning (first match wins).
Nothing here is logic; the Column functions that use these values live
next to this module.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: request sources, subjects and chapters offered to students
# ---------------------------------------------------------------------------
SOURCE_CHAPTER = "Chapter"
SOURCE_UPLOAD = "Upload PDF"
SOURCE_CAMERA = "Camera Document (📱 NEW!)"
SUBJECTS = ["Hindi", "Math", "Science", "English", "Social Studies"]

INTENT_SMART = "smart_first_response"
INTENT_GREETING = "greeting"
INTENT_FOLLOW_UP = "follow_up"

# ---------------------------------------------------------------------------
# FIXED VALUES: question handling (is_specific_question, normalize_question)
# ---------------------------------------------------------------------------
QUESTION_WORDS = [
    "what", "how", "why", "where", "when", "which", "who", "can you", "could you",
    "please", "help me", "explain", "tell me", "meaning", "define", "solve",
]
GENERIC_GREETINGS = ["hi", "hello", "hey", "good morning", "good afternoon", "namaste"]

# (whole phrase, case-insensitive) -> replacement, applied in this order
NORMALIZE_REWRITES = [
    ("hard words", "difficult words"),
    ("tricky words", "difficult words"),
    ("meaning of the words", "meanings of difficult words"),
    ("their english meanings", "their English meanings"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: fallback_for_unknown
# ---------------------------------------------------------------------------
VOCAB_KEYWORDS = ["meaning", "word", "hard word", "difficult word", "english meaning", "vocabulary"]
VOCAB_REPLY = (
    "It seems like you're asking about difficult words and their meanings. "
    "Please tell me which word from the chapter you'd like to understand, "
    "or I can explain some common tricky words for you."
)
REDIRECT_REPLY_HEAD = "That's an interesting thought, but let's focus on "
REDIRECT_REPLY_TAIL = ". What part of the chapter would you like help with?"

# ---------------------------------------------------------------------------
# FIXED VALUES: tool error markers (case-sensitive)
# ---------------------------------------------------------------------------
TOOL_ERROR_MARKERS = [
    "I can only help",
    "couldn't extract any text",
    "encountered an error",
    "Please upload",
]
TOOL_MARKER = "record_unknown_question"

# ---------------------------------------------------------------------------
# FIXED VALUES: clean_response
# ---------------------------------------------------------------------------
THOUGHT_PATTERNS = [
    "thought:", "i need to", "i should", "i must", "i will", "let me think",
    "my goal is", "my task is", "i am tasked", "oh dear", "it seems",
    "my apologies", "i tried to", "i made a mistake", "i need to remember",
    "since the student", "let me", "i'll maintain", "keeping in mind",
    "let's break down",
]
REASONING_PREFIXES = [
    "thought:", "i need", "i should", "i must", "i will", "let me",
    "my goal", "my task", "oh dear", "it seems", "since the", "keeping",
]
CLEAN_FALLBACK = "I'm here to help you! Could you please repeat your question?"

# ---------------------------------------------------------------------------
# FIXED VALUES: identify_content_type (live variant). Substring tests on the
# lower-cased text; subjects are tried in this order. The math keyword
# "जोड़" ends in U+0921 U+093C (decomposed nukta), as in the rules.
# ---------------------------------------------------------------------------
CONTENT_SUBJECTS = [
    ("math", ["math", "mathematics", "algebra", "geometry", "arithmetic",
              "addition", "subtraction", "multiplication", "division",
              "गणित", "जोड़", "घटाव", "गुणा", "भाग", "अंकगणित"]),
    ("english", ["english", "grammar", "vocabulary", "reading", "writing", "story", "poem",
                 "अंग्रेजी", "व्याकरण", "शब्दावली", "पठन", "लेखन", "कहानी", "कविता"]),
    ("science", ["science", "physics", "chemistry", "biology", "experiment", "observation",
                 "विज्ञान", "भौतिकी", "रसायन", "जीवविज्ञान", "प्रयोग", "निरीक्षण"]),
    ("history", ["history", "ancient", "medieval", "freedom", "independence", "rulers",
                 "इतिहास", "प्राचीन", "मध्यकालीन", "स्वतंत्रता", "राजा", "सम्राट"]),
    ("geography", ["geography", "map", "continent", "country", "climate", "river", "mountain",
                   "भूगोल", "नक्शा", "महाद्वीप", "देश", "जलवायु", "नदी", "पर्वत"]),
    ("hindi", ["hindi", "language", "literature", "poetry", "story", "grammar",
               "हिंदी", "भाषा", "साहित्य", "कविता", "व्याकरण", "कहानी"]),
]
HOMEWORK_WORDS = ["homework", "assignment", "complete", "solve", "गृहकार्य", "अभ्यास", "हल करें", "पूरा करें"]
TEXTBOOK_WORDS = ["chapter", "lesson", "learn", "understand", "अध्याय", "पाठ", "सीखें", "समझें"]
QUESTION_INDICATORS = ["?", "what", "how", "why", "where", "when", "which", "solve", "find", "calculate",
                       "क्या", "कैसे", "क्यों", "कहाँ", "कब", "कौन", "हल करें", "ढूँढें", "गणना करें"]
EXERCISE_INDICATORS = ["exercise", "practice", "solve", "complete", "fill", "choose", "match",
                       "अभ्यास", "प्रयोग", "हल", "पूरा", "भरें", "चुनें", "मिलाएँ"]

# FIXED VALUES: identify_content_type (legacy variant, English only, five subjects)
LEGACY_CONTENT_SUBJECTS = [
    ("math", ["math", "mathematics", "algebra", "geometry", "arithmetic",
              "addition", "subtraction", "multiplication", "division"]),
    ("english", ["english", "grammar", "vocabulary", "reading", "writing", "story", "poem"]),
    ("science", ["science", "physics", "chemistry", "biology", "experiment", "observation"]),
    ("history", ["history", "ancient", "medieval", "freedom", "independence", "rulers"]),
    ("geography", ["geography", "map", "continent", "country", "climate", "river", "mountain"]),
]
LEGACY_HOMEWORK_WORDS = ["homework", "assignment", "complete", "solve"]
LEGACY_TEXTBOOK_WORDS = ["chapter", "lesson", "learn", "understand"]
LEGACY_QUESTION_INDICATORS = ["?", "what", "how", "why", "where", "when", "which", "solve", "find", "calculate"]
LEGACY_EXERCISE_INDICATORS = ["exercise", "practice", "solve", "complete", "fill", "choose", "match"]

# ---------------------------------------------------------------------------
# FIXED VALUES: detect_language threshold (Devanagari block over letters > 0.3)
# ---------------------------------------------------------------------------
DEVANAGARI_FIRST = 0x0900
DEVANAGARI_LAST = 0x097F

# ---------------------------------------------------------------------------
# FIXED VALUES: answer_from_document help types and their replies
# ---------------------------------------------------------------------------
HELP_TERMS_WORDS = ["meaning", "what does", "define"]
HELP_SOLUTION_WORDS = ["solve", "answer", "how to"]
HELP_EXPLANATION_WORDS = ["explain", "why", "how"]
HELP_TEMPLATES = {
    "terms": ("Let me help you understand the terms in your question!\n\n",
              "\n\nBased on your document, I can explain this concept in simple words. "
              "What specific word or term would you like me to focus on?"),
    "solution": ("I'll help you solve this step by step!\n\n",
                 "\n\nLet me break this down into smaller, easier steps. First, let's understand "
                 "what the question is asking, then we'll solve it together."),
    "explanation": ("Great question! Let me explain this concept clearly.\n\n",
                    "\n\nI'll use simple examples to help you understand this better."),
    "general": ("I'm here to help with your question!\n\n",
                "\n\nCould you tell me more specifically what you need help with? For example:\n"
                "• Do you need word meanings?\n• Should I solve a problem?\n"
                "• Do you want an explanation of a concept?"),
}
NO_DOCUMENT_REPLY = "I don't have any document content to reference. Please upload your homework or textbook first!"
BLANK_DOCUMENT_QUESTION_REPLY = "Please ask a question about your uploaded document!"

# ---------------------------------------------------------------------------
# FIXED VALUES: tool replies
# ---------------------------------------------------------------------------
UNKNOWN_QUESTION_REPLY_HEAD = "That's an interesting thought! But let's focus on "
UNKNOWN_QUESTION_REPLY_TAIL = ". What would you like to learn today?"
USER_DETAILS_REPLY = "Thank you for sharing your details! Let's continue learning."

# ---------------------------------------------------------------------------
# FIXED VALUES: helpful response after an upload was processed
# ---------------------------------------------------------------------------
HELPFUL_HEAD = "Great! I can see this is "
HELPFUL_TYPE_PHRASES = {"homework": "homework assignment. ", "textbook": "textbook content. "}
HELPFUL_OTHER_TYPE_PHRASE = "study material. "
HELPFUL_ASKED_HEAD = "You asked: '"
HELPFUL_ASKED_TAIL = "'\n\n"
HELPFUL_OFFER = (
    "I can help you with:\n"
    "• Explaining difficult concepts\n"
    "• Breaking down complex problems\n"
    "• Providing step-by-step solutions\n"
    "• Explaining the meaning of difficult words\n\n"
)
HELPFUL_QUESTIONS_NOTE = (
    "I noticed there are questions in your document. "
    "Would you like me to help you solve them step by step?\n\n"
)
HELPFUL_CLOSING = (
    "What specific part would you like help with? "
    "You can ask me about any concept, word, or problem you see!"
)

# ---------------------------------------------------------------------------
# FIXED VALUES: upload gates and status replies
# ---------------------------------------------------------------------------
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp"]
PDF_SUFFIX = ".pdf"
UNSUPPORTED_UPLOAD_REPLY = "I can only help with PDF files and images (JPG, PNG, BMP). Please upload a supported file type."
NO_TEXT_UPLOAD_REPLY = ("I couldn't extract any text from this document. Could you try taking a clearer photo "
                        "or check if the document is readable?")
UPLOAD_ERROR_REPLY = ("I encountered an error processing your document. Could you try uploading it again "
                      "or ask me your question directly?")
CAMERA_PROMPT_GREETING = "Please upload your homework or textbook photo/PDF first!"
CAMERA_PROMPT_QUESTION = "Please upload your homework or textbook first!"
CAMERA_PROMPT_PLAIN = "Please upload a document first!"
NO_PDF_UPLOADED = "No PDF uploaded. Please upload a chapter PDF."
NOT_FOUND_HEAD = "Sorry, I couldn't find your content. "
UNREADABLE_HEAD = "I found a file but couldn't read text from it. "
UPLOAD_NOT_FOUND_HEAD = "Uploaded file not found: "
UNSUPPORTED_HEAD = "Unsupported file type: "
UNSUPPORTED_TAIL = ". Please upload a .pdf"
UPLOAD_NO_TEXT = "The uploaded PDF has no extractable text. It may be scanned. Try OCR."
CHAPTER_NOT_FOUND_HEAD = "Content not found: "
CHAPTER_NO_TEXT_HEAD = "PDF has no extractable text: "
CHAPTER_NO_TEXT_TAIL = ". Consider using OCR for scanned documents."
GENERIC_ERROR_REPLIES = {
    "greeting": "Oops! Something went wrong while starting the session. Please try again.",
    "smart_first_response": "Oops! Something went wrong while answering your question. Please try again.",
    "follow_up": "Oops! Something went wrong while answering your question. Please try again.",
}

# ---------------------------------------------------------------------------
# FIXED VALUES: default replies after cleaning
# ---------------------------------------------------------------------------
GREETING_DEFAULT_HEAD = "Hello! Good morning! I'm your "
GREETING_DEFAULT_TAIL = (" teacher. Would you like me to explain the chapter, "
                         "give meanings of words, or answer a question?")
CLARIFY_DEFAULT = "I'm here to help! Could you clarify your question?"
CAMERA_EMPTY_DEFAULT = ("I processed your document but couldn't generate a response. "
                        "Please try asking your question again.")

# ---------------------------------------------------------------------------
# FIXED VALUES: history, transcript, quick actions
# ---------------------------------------------------------------------------
EMPTY_MESSAGE_DISPLAY = "👋 Starting session..."
TRANSCRIPT_TURN_HEAD = "### 💬 Turn "
TRANSCRIPT_USER_HEAD = "**You:** "
TRANSCRIPT_TEACHER_HEAD = "**Teacher:** "
TRANSCRIPT_SEPARATOR = "\n\n---\n\n"
TURN_LABEL_HEAD = "Turn "
QUICK_ACTIONS = [
    ("explain", "Please explain what's on this page"),
    ("solve", "Help me solve the problems on this page"),
    ("words", "Explain the difficult words on this page"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES: session content file header and audio defaults
# ---------------------------------------------------------------------------
SESSION_CONTENT_MARKER = "CONTENT_TYPE:"
SESSION_CONTENT_HEAD = "CONTENT_TYPE: "
DEFAULT_AUDIO_SUFFIX = ".mp3"
OCR_PAGE_HEAD = "\n--- Page "
OCR_PAGE_TAIL = " ---\n"
OCR_MIN_PREFERRED_LENGTH = 20       # a hindi/combined candidate must be longer than this
REGULAR_TEXT_MIN_LENGTH = 50        # regular extraction is used when longer than this

# ---------------------------------------------------------------------------
# FIXED VALUES: Python whitespace (str.isspace) and the cp1252 upper half
# ---------------------------------------------------------------------------
PY_WHITESPACE = "".join(chr(i) for i in range(0x10000) if chr(i).isspace())
# bytes 0x80..0x9F that cp1252 maps to characters other than the latin-1 controls
CP1252_UPPER = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…",
    0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š",
    0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’",
    0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—",
    0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ",
    0x9E: "ž", 0x9F: "Ÿ",
}
CP1252_UNDEFINED = [0x81, 0x8D, 0x8F, 0x90, 0x9D]
