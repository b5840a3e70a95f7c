"""Text of page images through an optional recogniser: the image is prepared, several readings compete by their words.

``Reader`` stands between the rules and the engine: (image, page segmentation mode) -> text. Tests and other engines bring
their own; ``engine_reader`` is the common one and needs two optional packages.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterable, Iterator

Reader = Callable[[object, int], str]

#: Widths to scale to, and strength of contrast, sharpening and unsharp masking (radius, percent, threshold).
LEAST_WIDTH, MOST_WIDTH, REDUCED_WIDTH, LEAST_SCALE = 2400, 3600, 3000, 2.0
CONTRAST, SHARPNESS, UNSHARP = 1.8, 1.6, (1.5, 150, 3)
#: First mode, modes for a sparse page and below how many words it is one.
MODE, SPARSE_MODES, SPARSE_WORDS = 3, (1, 6, 11), 35
#: The header's height, the columns' bands (of the width), their mode, and when they win.
HEADER, LEFT_BAND, RIGHT_BAND, COLUMN_MODE = 0.15, (0.0, 0.38), (0.36, 1.0), 6
LEFT_WORDS, RIGHT_WORDS, COLUMN_SHARE = 15, 25, 0.90
#: Where the engine is looked for when it is not on the path.
ENGINE_PLACES = ("/usr/bin/tesseract", "/usr/local/bin/tesseract")


def words(text: str) -> int:
    return len(text.split())


def find_engine(places: Iterable[str] = ENGINE_PLACES) -> str | None:
    """The engine's executable: on the path, else at one of the places."""
    return next((p for p in (shutil.which("tesseract"), *places) if p and os.access(p, os.X_OK) and os.path.isfile(p)), None)


def engine_reader() -> Reader:
    import pytesseract

    pytesseract.pytesseract.tesseract_cmd = find_engine() or pytesseract.pytesseract.tesseract_cmd
    return lambda image, mode: pytesseract.image_to_string(image, config=f"--oem 3 --psm {mode}")


def scaled_size(width: int, height: int) -> tuple[int, int]:
    """Small images grow to a page's width, at least twofold; very large ones shrink."""
    factor = max(LEAST_SCALE, LEAST_WIDTH / max(width, 1)) if width < LEAST_WIDTH else REDUCED_WIDTH / width if width > MOST_WIDTH else 1.0
    return int(width * factor), int(height * factor)


def upright(image):
    """The image turned as the engine's orientation detection says; as it is where that fails."""
    try:
        import pytesseract

        factor = min(1.0, 1000 / max(image.size[0], 1))
        turn = pytesseract.image_to_osd(image.resize((max(1, int(image.size[0] * factor)), max(1, int(image.size[1] * factor)))), output_type=pytesseract.Output.DICT).get("rotate", 0)
        return image.rotate(-turn, expand=True) if turn in (90, 180, 270) else image
    except Exception:
        return image


def variants(image) -> list:
    """Two greyscale forms of one image: strong contrast and sharpened, and unsharp masked."""
    from PIL import ImageEnhance, ImageFilter

    page = upright(image if image.mode in ("RGB", "L") else image.convert("RGB"))
    size = scaled_size(*page.size)
    grey = (page if size == page.size else page.resize(size)).convert("L")
    radius, percent, threshold = UNSHARP
    return [ImageEnhance.Sharpness(ImageEnhance.Contrast(grey).enhance(CONTRAST)).enhance(SHARPNESS), grey.filter(ImageFilter.UnsharpMask(radius=radius, percent=percent, threshold=threshold))]


def _readings(forms: list, modes: Iterable[int], read: Reader) -> Iterator[str]:
    for form in forms:
        for mode in modes:
            try:
                yield read(form, mode)
            except Exception:  # one reading that fails leaves the others
                continue


def in_columns(form, read: Reader) -> str:
    """Header, right and left column read apart; empty unless both columns hold text."""
    width, height = form.size
    top = int(height * HEADER)
    boxes = [(0, 0, width, top), *((int(width * a), top, int(width * b), height) for a, b in (RIGHT_BAND, LEFT_BAND))]
    texts = [t.strip() for box in boxes for t in _readings([form.crop(box)], [COLUMN_MODE], read)]
    if len(texts) < 3 or words(texts[2]) <= LEFT_WORDS or words(texts[1]) <= RIGHT_WORDS:
        return ""
    return "\n\n".join(texts).strip()


def recognised(forms: list, read: Reader) -> str:
    """The reading with most words, the first of equals; columns win where they hold nearly as many."""
    best = max(_readings(forms, [MODE], read), key=words, default="")
    if words(best) < SPARSE_WORDS:
        best = max((best, *_readings(forms[:1], SPARSE_MODES, read)), key=words)
    apart = in_columns(forms[0], read) if forms else ""
    return (apart if apart and words(apart) >= COLUMN_SHARE * words(best) else best).strip()


def image_text(image, read: Reader | None = None) -> str:
    return recognised(variants(image), read or engine_reader())
