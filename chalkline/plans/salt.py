"""Salt phrases and derivation constants shared by the Spark inputs and the
DuckDB oracle, so both sides build byte-identical input tables.

A phrase is chosen by ``id % len(list)`` and prepended to the whole text;
every list keeps an empty phrase so raw text is exercised too.
"""

from __future__ import annotations

from chalkline.functions.rules import SOURCE_CAMERA, SOURCE_CHAPTER, SOURCE_UPLOAD, SUBJECTS

CONTENT_PHRASES = ["algebra homework", "This chapter tells a story", "physics experiment", "ancient rulers",
                   "river and mountain", "हिंदी भाषा", "नदी और पर्वत", "कविता और भाषा",
                   "Complete the exercise?", ""]
QUESTION_PHRASES = ["Explain the hard words", "TRICKY WORDS", "meaning of the words", "hello there", "history?",
                    "how to solve this", "What does osmosis do?", "ok", "define atom", ""]
ANSWER_PHRASES = ["Thought: I need to plan\n", "Let me think\n", "The word thought means an idea\n",
                  "record_unknown_question\n", "Well done!\n", ""]
SPEECH_PHRASES = ["**Bold** (aside)\n", "1. Add\n", "Note: be kind\n", "Note: done!\n", "Intro\n• one\n",
                  "English meaning: tree\n", ""]
LANGUAGE_PHRASES = ["नमस्ते नमस्ते नमस्ते", "क abc", "क ab", "१२३", "।।।", ""]
ERROR_PHRASES = ["I can only help with PDF files", "Please upload a file", "please upload", ""]
SUBJECT_CHOICES = list(SUBJECTS)
CHAPTER_CHOICES = ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "11", "x", None]
SOURCE_CHOICES = [SOURCE_CHAPTER, SOURCE_UPLOAD, SOURCE_CAMERA]
FILE_NAMES = ["a.pdf", "b.JPG", "c.jpeg", "d.png", "e.bmp", "f.docx", "noext", ".pdf", "g.tar.pdf"]
ACTION_CODES = ["explain", "solve", "words", "draw"]
CATALOG_SUBJECTS = ["hindi", "math", "science", "english", "social studies", "geography"]

# request timing: hour of the turn plus a per-session offset inside the hour
EPOCH_2024 = 1704067200
TURN_SECONDS = 3600
SESSION_OFFSET_MULT = 7919
EVENT_ID_MULT = 4_294_967_311   # event_id = conv_id * this + turn: above any 32-bit turn, so no two turns share an id
# the response index is the state after this many hours of traffic; later entries are updates
INDEX_CUTOFF_TURN = 2
