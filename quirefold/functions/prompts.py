"""Prompts of the three alignment methods, filled by expressions (braces in the data are harmless)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt templates and example labels, as the models were evaluated with.
TEMPLATES = {
    "m1": """# Role and Objective
Process a scanned page image and its transcription (continuous text; no line breaks) to reconstruct line breaks that match the page's visual line layout.

# Instructions
- Examine the page image to locate each visually distinct line of text, including headings, marginalia, and indented lines.
- Locate the exact wording for each visible line within the transcription.
- Insert newline characters at precise locations matching the visual end of each line in the image.
- Do not add, remove, or alter any characters other than adding newlines.
- Output only the visible text from the provided page, segmented precisely by these line breaks.
- Ignore image lines that do not have an exact transcriptional match.

# Output Format
Return a single block of text: each line corresponds to a visually distinct line in the image, separated by newline characters (not '\\n'). Do not include explanations, errors, or extra formatting—output only the corrected text segment.

{examples}Transcription:
{transcription}""",
    "m2": """# Role and Objective
Align the correct transcription of a scanned page to match the visual line structure, using the page image as the primary reference and HTR/OCR output as a structural guide.

# Instructions
- Use the page image as the main reference for true visual line breaks.
- Use the HTR/OCR output to help identify line boundaries, especially where the image is ambiguous.
- Insert newline characters into the correct transcription at positions matching visual line ends.
- Do not add, remove, or alter any characters other than adding newlines.
- Each visual line in the image should correspond to one line in your output.
- Output only the visible text from this page, segmented by line breaks.

# Output Format
Return the correct transcription with inserted line breaks. Each line corresponds to a visual line in the image. Do not include explanations or extra formatting.

{examples}Correct transcription:
{transcription}

HTR/OCR output with line breaks:
{htr}""",
    "m3": """# Role and Objective
Align a correct transcription (no line breaks) to match the line structure indicated by an HTR/OCR output (which has line breaks but may contain character errors).

# Instructions
- Use the HTR/OCR output to determine where line breaks should be inserted in the correct transcription.
- Do not add, remove, or alter any characters in the transcription other than inserting newlines.
- Handle HTR/OCR character errors by finding the best alignment between corresponding text segments.
- Each line in the HTR/OCR should correspond to one line in your output.

# Output Format
Return only the correct transcription with inserted line breaks matching the HTR/OCR structure. Do not include explanations, code blocks, or extra formatting.

{examples}Correct transcription:
{transcription}

HTR/OCR output with line breaks:
{htr}""",
}
EXAMPLE_HEAD = "Here are some examples:\n\n"
EXAMPLE_FOOT = "Now, apply the same approach to the following:\n\n"
EXAMPLE_PARTS = {
    "m1": (("Transcription:\n", "transcription"), ("Output with line breaks:\n", "gt_text")),
    "m2": (("Correct transcription:\n", "transcription"), ("HTR/OCR output with line breaks:\n", "ocr_text"), ("Output with correct line breaks:\n", "gt_text")),
    "m3": (("Correct transcription:\n", "transcription"), ("HTR/OCR output with line breaks:\n", "ocr_text"), ("Output with correct line breaks:\n", "gt_text")),
}


def examples_text(method: str, examples: Column) -> Column:
    """Numbered examples between head and foot; empty for none. examples: array of structs as in operators.fewshot."""

    def one(e: Column, i: Column) -> Column:
        parts = [F.concat(F.lit(label), F.coalesce(e[field], F.lit("None")), F.lit("\n\n")) for label, field in EXAMPLE_PARTS[method]]
        return F.concat(F.lit("Example "), (i + 1).cast("string"), F.lit(":\n"), *parts)

    body = F.array_join(F.transform(examples, one), "")
    return F.when(F.coalesce(F.size(examples), F.lit(0)) > 0, F.concat(F.lit(EXAMPLE_HEAD), body, F.lit(EXAMPLE_FOOT))).otherwise(F.lit(""))


def fill(template: str, **values: Column) -> Column:
    """A template with each {name} replaced by a column."""
    parts: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not found:
            parts.append(F.lit(rest))
            break
        at, key = min(found)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[key])
        rest = rest[at + len(key) + 2 :]
    return F.concat(*parts)


def render(method: str, transcription: Column, htr: Column | None = None, examples: Column | None = None) -> Column:
    shown = F.lit("") if examples is None else examples_text(method, examples)
    values = {"examples": shown, "transcription": transcription}
    if method != "m1":
        values["htr"] = F.lit("") if htr is None else F.coalesce(htr, F.lit(""))
    return fill(TEMPLATES[method], **values)
