"""Reply and prompt templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions import rules as R
from chalkline.functions.textops import col_of, is_blank

# ---------------------------------------------------------------------------
# FIXED VALUES: task descriptions and expected outputs, as they read after
# YAML folding; placeholders in braces are filled per request.
# ---------------------------------------------------------------------------
TASK_TEMPLATES = {
    'teaching_task': (
        'You are a CBSE Grade 3 {subject} teacher starting a new learning session for Chapter {chapter_number}.\n'
        'Your ONLY purpose is to greet the student warmly and ask what help they want.\n'
        'Rules: - Do NOT explain any concepts - Do NOT answer questions yet - Do NOT use any tools - Speak in short, friendly sentences suitable for a Grade 3 student\n'
        'Guidelines: - Greet the student warmly (1–2 sentences) - Ask ONE simple question:\n'
        '  “Do you want a full explanation, word meanings, or help with a question?”\n'
        '\n'
        'CRITICAL: - Do NOT use tools - Do NOT show thoughts or reasoning - Do NOT say “I need to”, “My goal”, or similar phrases - Speak only as a real teacher talking to the student - Keep response to 2–3 short sentences\n'
    ),
    'smart_response_task': (
        'The student asked their FIRST academic question: "{student_query}" from {subject} Chapter {chapter_number}.\n'
        'You are their CBSE Grade 3 {subject} teacher.\n'
        'IMPORTANT CONTEXT: - This is NOT a greeting - Do NOT introduce yourself again - Do NOT repeat chapter details\n'
        'Use {chapter_content} to answer the question immediately.\n'
        'Teaching guidelines: - Use simple Grade 3 language - Prefer short sentences - Explain step by step - English first; use Hindi words only if it helps understanding - Be kind, encouraging, and patient\n'
        'Response structure: 1. Directly answer what the student asked 2. Give a simple explanation or example 3. End with gentle encouragement or a simple follow‑up offer\n'
        'CRITICAL: - Respond ONLY as the teacher - No internal reasoning, planning, or meta commentary - Never say “I think”, “I need to”, “My task is”\n'
    ),
    'follow_up_task': (
        'The student asked: "{student_query}"\n'
        'You are their CBSE Grade 3 {subject} teacher. Use {chapter_content} where helpful.\n'
        'Decide response type: - Word meanings → explain simply, one word at a time - Chapter explanation → explain in short steps - Specific question → answer clearly and kindly\n'
        'Tool rules: - Use `record_unknown_question` ONLY if the question is completely unrelated\n'
        '  to studies or the chapter\n'
        '- Vocabulary, meanings, grammar, or concept doubts are ALWAYS valid - Use `record_user_details` ONLY if contact details are explicitly shared\n'
        'Teaching style: - Calm, friendly, and encouraging - Short sentences - English first, Hindi only for clarification\n'
        'CRITICAL: - Speak only as a teacher to the student - No internal thoughts or planning language - No meta commentary\n'
    ),
    'document_analysis_task': (
        'A student has uploaded a document or photo.\n'
        'Subject: {subject} Student question: {student_question} Extracted document text: {document_text}\n'
        'Tool decision rules (STRICT): - If {document_text} is EMPTY → you MUST use `process_uploaded_document` - If {document_text} is NOT empty → DO NOT reprocess the document\n'
        'Your responsibilities: 1. Briefly acknowledge what the document contains 2. Answer the student’s question using the document 3. Explain step by step in Grade 3 language 4. Encourage the student gently\n'
        'Tool usage: - Use `answer_from_document` only when directly answering from document content - Do NOT use tools unnecessarily\n'
        'Language rules: - Hindi subject → respond in Hindi - All other subjects → English (Hindi words only for help)\n'
        'CRITICAL: - Speak only as the teacher - No internal reasoning or meta language - Sound like a real teacher helping kindly\n'
    ),
}
TASK_EXPECTED_OUTPUTS = {
    'teaching_task': 'A short, friendly teacher greeting (2–3 sentences) suitable for a Grade 3 student. No explanations, no meta language, no tools.\n',
    'smart_response_task': 'A natural teacher response that directly answers the student’s question in simple, friendly, Grade 3 language.\n',
    'follow_up_task': 'A warm, natural teacher response that directly answers the student’s request in simple Grade 3 language.\n',
    'document_analysis_task': 'A warm, helpful teacher response that clearly explains the document content and helps the student confidently.\n',
}

_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


def template_parts(template: str) -> list:
    """Split a template at its placeholders once, on the driver: literal
    strings and placeholder names alternate. Filling is then a ``concat``,
    so student text is never searched for placeholders and never read as a
    regex replacement."""
    out, pos = [], 0
    for m in _PLACEHOLDER.finditer(template):
        out.append(template[pos:m.start()])
        out.append(("field", m.group(1)))
        pos = m.end()
    out.append(template[pos:])
    return out


def fill_template(template: str, values: dict) -> Column:
    """A template with every placeholder replaced by its column (null as '')."""
    cols = []
    for part in template_parts(template):
        if isinstance(part, tuple):
            cols.append(F.coalesce(values[part[1]], F.lit("")))
        elif part:
            cols.append(F.lit(part))
    return F.concat(*cols)


def render_prompt(task, values: dict) -> Column:
    """The prompt of a task chosen per row (one of ``TASK_TEMPLATES``)."""
    t = col_of(task)
    out = None
    for name, template in TASK_TEMPLATES.items():
        filled = fill_template(template, values)
        out = F.when(t == name, filled) if out is None else out.when(t == name, filled)
    return out


def helpful_response(info, question) -> Column:
    """The reply after an upload is processed, from its content info."""
    i, q = col_of(info), col_of(question)
    subject = F.when(i["subject"] != "unknown", F.concat(F.lit("a "), F.initcap(i["subject"]), F.lit(" "))) \
        .otherwise(F.lit(""))
    kind = (F.when(i["type"] == "homework", F.lit(R.HELPFUL_TYPE_PHRASES["homework"]))
            .when(i["type"] == "textbook", F.lit(R.HELPFUL_TYPE_PHRASES["textbook"]))
            .otherwise(F.lit(R.HELPFUL_OTHER_TYPE_PHRASE)))
    asked = F.when(q.isNotNull() & (q != ""), F.concat(F.lit(R.HELPFUL_ASKED_HEAD), q, F.lit(R.HELPFUL_ASKED_TAIL))) \
        .otherwise(F.lit(""))
    note = F.when(i["has_questions"], F.lit(R.HELPFUL_QUESTIONS_NOTE)).otherwise(F.lit(""))
    return F.concat(F.lit(R.HELPFUL_HEAD), subject, kind, asked, F.lit(R.HELPFUL_OFFER), note,
                    F.lit(R.HELPFUL_CLOSING))


def help_template(kind, question) -> Column:
    """The reply template of a help type, embedding the question."""
    k, q = col_of(kind), F.coalesce(col_of(question), F.lit(""))
    out = None
    for name, (head, tail) in R.HELP_TEMPLATES.items():
        filled = F.concat(F.lit(head), q, F.lit(tail))
        out = F.when(k == name, filled) if out is None else out.when(k == name, filled)
    return out


def help_reply(question, has_document) -> Column:
    """P11 + T6 + T10: blank question and missing document prompts first."""
    from chalkline.functions.questions import help_type
    return (F.when(is_blank(question), F.lit(R.BLANK_DOCUMENT_QUESTION_REPLY))
            .when(~col_of(has_document), F.lit(R.NO_DOCUMENT_REPLY))
            .otherwise(help_template(help_type(question), question)))
