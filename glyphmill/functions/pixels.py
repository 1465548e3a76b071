"""What needs pixels, with numpy, for use inside Arrow-batched workers: resizing, tensors, components, rectangles, crops."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

#: Channel means and deviations of the usual training images.
MEAN, STD = np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = image.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = image.astype(np.float32).reshape(h, w, -1)
    top, low = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx, p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return (top * (1 - fy) + low * fy).reshape(height, width, *image.shape[2:])


def detection_tensor(image: np.ndarray, height: int, width: int, flip_channels: bool = True) -> np.ndarray:
    """(1, 3, height, width), normalised; flip_channels: the image is BGR."""
    p = resize(image, height, width)
    p = (p[:, :, ::-1] if flip_channels else p) / 255
    return ((p - MEAN) / STD).transpose(2, 0, 1)[None].astype(np.float32)


def recognition_tensor(crops: list[np.ndarray], height: int = 48, most: int | None = 320, unit: int | None = None) -> np.ndarray:
    """(n, 3, height, w): crops scaled to one height, padded with 0 to the widest ratio, at most `most` wide.

    unit: pixels of width for a ratio of 1, the height unless given. Models for live frames take a unit of 32 and no limit.
    """
    width = int((unit or height) * max(c.shape[1] / c.shape[0] for c in crops))
    width = min(most, width) if most else width
    width = max(1, width)
    out = np.zeros((len(crops), 3, height, width), np.float32)
    for row, c in zip(out, crops, strict=True):
        w = max(1, min(width, int(np.ceil(height * c.shape[1] / c.shape[0]))))
        row[:, :, :w] = ((resize(c, height, w) / 255 - 0.5) / 0.5).transpose(2, 0, 1)
    return out


def batches(ratios: list[float], size: int = 6) -> list[list[int]]:
    """Indices by rising ratio, in batches, so that a batch needs little padding."""
    order = np.argsort(ratios, kind="stable").tolist()
    return [order[i : i + size] for i in range(0, len(order), size)]


def _labelled(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """Component number of each set pixel from 1, 0 elsewhere: minima spread along rows, columns and diagonals until they stand."""
    big = mask.size + 1
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), big)
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    while True:
        new = label.copy()
        for dy, dx in steps:
            moved = np.full_like(label, big)
            h, w = label.shape
            moved[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] = label[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)]
            new = np.where(mask, np.minimum(new, moved), big)
        flat = np.append(new.ravel(), big)
        jump = np.where(mask, np.minimum(new, flat[np.minimum(new - 1, mask.size)]), big)  # follow the label to its own label
        if (jump == label).all():
            break
        label = jump
    out = np.unique(label, return_inverse=True)[1].reshape(mask.shape) + 1
    out[~mask] = 0
    return out


@dataclass
class Outline:
    """Of a component or a hole: border points (x, y), the pixels from (x0, y0) on that it encloses, border included, and how many corners its border has."""

    points: np.ndarray
    x0: int
    y0: int
    fill: np.ndarray
    corners: int


#: Steps (dy, dx) to the eight neighbours, clockwise from the right.
_AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def border_corners(own: np.ndarray) -> int:
    """Points at which the outer border of a component changes direction as one walks it; 1 for a single pixel. own: with a margin of one."""
    start = tuple(np.argwhere(own)[0].tolist())  # its left neighbour and those above are free
    at, came, steps, first = start, 4, [], None
    while True:
        for k in range(1, 9):
            d = (came + k) % 8
            if own[at[0] + _AROUND[d][0], at[1] + _AROUND[d][1]]:
                break
        else:
            return 1
        if at == start and d == first:
            break
        first = d if first is None else first
        steps.append(d)
        at = (at[0] + _AROUND[d][0], at[1] + _AROUND[d][1])
        came = (d + 4) % 8
    return max(1, sum(a != b for a, b in zip(steps, steps[1:] + steps[:1], strict=True)))


def _spots(label: np.ndarray) -> dict[int, tuple[slice, slice]]:
    """Bounding box of each label but 0."""
    y, x = np.nonzero(label)
    k = label[y, x]
    order = np.argsort(k, kind="stable")
    y, x, k = y[order], x[order], k[order]
    first = np.flatnonzero(np.diff(k, prepend=0))
    bounds = [f.reduceat(v, first).tolist() if len(first) else [] for f, v in ((np.minimum, y), (np.maximum, y), (np.minimum, x), (np.maximum, x))]
    return {int(n): (slice(y0, y1 + 1), slice(x0, x1 + 1)) for n, y0, y1, x0, x1 in zip(k[first], *bounds, strict=True)}


def _wider(spot: tuple[slice, slice]) -> tuple[slice, slice]:
    return tuple(slice(s.start - 1, s.stop + 1) for s in spot)


def outlines(mask: np.ndarray) -> list[Outline]:
    """One of each component, nested ones too, and one around each hole. Work per component is that of its bounding box."""
    found = []
    padded = np.pad(mask.astype(bool), 2)  # a margin of one for boxes that are one wider all around
    fore, back = _labelled(padded, True), _labelled(~padded, False)
    for k, spot in _spots(fore).items():
        spot = _wider(spot)
        own = fore[spot] == k
        free = _labelled(~own, False)
        outside = free == free[0, 0]
        y0, x0 = spot[0].start - 2, spot[1].start - 2
        found.append(Outline(np.argwhere(own & _touching(outside))[:, ::-1] + [x0, y0], x0 + 1, y0 + 1, ~outside[1:-1, 1:-1], border_corners(own)))
    outer = back[0, 0]
    for k, spot in _spots(back).items():
        if k != outer:
            spot = _wider(spot)
            hole = back[spot] == k
            border = padded[spot] & _touching(hole)
            y0, x0 = spot[0].start - 2, spot[1].start - 2
            free = _labelled(~np.pad(border, 1), False)  # a border also encloses what stands within its hole
            # What goes around a hole has four corners at least.
            found.append(Outline(np.argwhere(border)[:, ::-1] + [x0, y0], x0, y0, (free != free[0, 0])[1:-1, 1:-1], 4))
    return found


def _touching(mask: np.ndarray) -> np.ndarray:
    out = np.zeros_like(mask)
    out[1:] |= mask[:-1]
    out[:-1] |= mask[1:]
    out[:, 1:] |= mask[:, :-1]
    out[:, :-1] |= mask[:, 1:]
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise in a plane with y upwards."""
    p = np.unique(points, axis=0).astype(float)
    if len(p) < 3:
        return p

    def half(order) -> list:
        out: list = []
        for q in order:
            while len(out) > 1 and np.cross(np.append(out[-1] - out[-2], 0), np.append(q - out[-2], 0))[2] <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def least_rectangle(points: np.ndarray) -> np.ndarray:
    """Corners of the rectangle of least area around points: one side lies on the hull."""
    h = hull(points)
    if len(h) < 2:
        return np.repeat(h, 4, axis=0)[:4]
    edges = np.diff(np.vstack([h, h[:1]]), axis=0)
    edges = edges[np.hypot(*edges.T) > 0]
    u = edges / np.hypot(*edges.T)[:, None]
    v = np.column_stack([-u[:, 1], u[:, 0]])
    a, b = h @ u.T, h @ v.T
    best = int(((a.max(0) - a.min(0)) * (b.max(0) - b.min(0))).argmin())
    lo, hi, bottom, top = a[:, best].min(), a[:, best].max(), b[:, best].min(), b[:, best].max()
    return np.array([s * u[best] + t * v[best] for s, t in ((lo, bottom), (hi, bottom), (hi, top), (lo, top))])


def outline_score(probabilities: np.ndarray, outline: Outline) -> float:
    """Mean probability of the pixels an outline encloses."""
    h, w = outline.fill.shape
    part = probabilities[outline.y0 : outline.y0 + h, outline.x0 : outline.x0 + w]
    return float((part * outline.fill).sum() / (outline.fill.sum() + 1e-6))


def boxes(probabilities: np.ndarray, threshold: float = 0.3, box_threshold: float = 0.6) -> list[np.ndarray]:
    """Least rectangles around all outlines over the threshold that have four corners or more and a mean of box_threshold or more.

    Rectangles are small here: sides are tested once they have been grown.
    """
    found = (o for o in outlines(probabilities > threshold) if o.corners >= 4)
    return [least_rectangle(o.points) for o in found if outline_score(probabilities, o) >= box_threshold]


def crop(image: np.ndarray, quad: np.ndarray, width: int, height: int) -> np.ndarray:
    """The quad's content upright: a perspective map sampled bilinearly, with the border repeated."""
    target = np.array([(0, 0), (width, 0), (width, height), (0, height)], float)
    rows = []
    for (x, y), (u, v) in zip(target, quad, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, u], [0, 0, 0, x, y, 1, -v * x, -v * y, v]]
    system = np.array(rows, float)
    m = np.append(np.linalg.solve(system[:, :8], system[:, 8]), 1).reshape(3, 3)
    y, x = np.mgrid[:height, :width]
    u, v, w = m @ np.stack([x.ravel(), y.ravel(), np.ones(x.size)])
    h0, w0 = image.shape[:2]
    u, v = np.clip(u / w, 0, w0 - 1), np.clip(v / w, 0, h0 - 1)
    x0, y0 = u.astype(int), v.astype(int)
    x1, y1 = np.minimum(x0 + 1, w0 - 1), np.minimum(y0 + 1, h0 - 1)
    fx, fy = (u - x0)[:, None], (v - y0)[:, None]
    p = image.astype(np.float32)
    out = (p[y0, x0] * (1 - fx) + p[y0, x1] * fx) * (1 - fy) + (p[y1, x0] * (1 - fx) + p[y1, x1] * fx) * fy
    return out.reshape(height, width, -1)


def upright(image: np.ndarray, quad: list[tuple[float, float]]) -> np.ndarray:
    """The crop of an ordered quad, as high and wide as its longer sides in whole pixels."""
    q = np.array(quad, float)
    w, h = (int(max(np.hypot(*(q[a] - q[b])), np.hypot(*(q[c] - q[d])))) for a, b, c, d in ((0, 1, 2, 3), (0, 3, 1, 2)))
    return crop(image, q, w, h) if w and h else np.zeros((0, 0, image.shape[2]))


def png(image: np.ndarray) -> bytes:
    """A BGR or grey image as a PNG file."""
    p = np.clip(np.rint(image), 0, 255).astype(np.uint8).reshape(*image.shape[:2], -1)[:, :, ::-1]
    h, w, c = p.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), p.reshape(h, w * c)], axis=1)  # each line starts with its filter, none

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def draw_polygon(image: np.ndarray, points: list, colour: tuple[int, int, int], width: int = 2) -> None:
    """The closed polygon's sides on the image itself; fewer than four points draw nothing."""
    if len(points) < 4:
        return
    h, w = image.shape[:2]
    for (x0, y0), (x1, y1) in zip(points, [*points[1:], points[0]], strict=True):
        steps = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
        x, y = (np.rint(np.linspace(a, b, steps + 1)).astype(int) for a, b in ((x0, x1), (y0, y1)))
        for dy in range(width):
            for dx in range(width):
                ok = (0 <= x + dx) & (x + dx < w) & (0 <= y + dy) & (y + dy < h)
                image[y[ok] + dy, x[ok] + dx] = colour


#: Capital letters, digits and some marks in dots, five wide and seven high, a hexadecimal row of dots each.
_DOTS = {
    "A": "0E11111F111111", "B": "1E11111E11111E", "C": "0E11101010110E", "D": "1E11111111111E", "E": "1F10101E10101F", "F": "1F10101E101010", "G": "0E11101713110E", "H": "1111111F111111", "I": "0E04040404040E",
    "J": "0702020202120C", "K": "11121418141211", "L": "1010101010101F", "M": "111B1515111111", "N": "11191513111111", "O": "0E11111111110E", "P": "1E11111E101010", "Q": "0E11111115120D", "R": "1E11111E141211",
    "S": "0F10100E01011E", "T": "1F040404040404", "U": "1111111111110E", "V": "11111111110A04", "W": "11111115151B11", "X": "11110A040A1111", "Y": "11110A04040404", "Z": "1F01020408101F", "0": "0E11131519110E",
    "1": "040C040404040E", "2": "0E11010204081F", "3": "1F02040201110E", "4": "02060A121F0202", "5": "1F101E0101110E", "6": "0608101E11110E", "7": "1F010204080808", "8": "0E11110E11110E", "9": "0E11110F01020C",
    "-": "0000001F000000", ".": "00000000000C0C", "/": "00010204081000", "(": "02040808080402", ")": "08040202020408", ":": "000C0C000C0C00", " ": "00000000000000",
}


def write_text(image: np.ndarray, text: str, x: int, y: int, colour: tuple[int, int, int], scale: int = 1) -> None:
    """Text on the image itself, its lower left corner at (x, y); small letters as capitals, characters without dots as a frame."""
    h, w = image.shape[:2]
    for i, c in enumerate(text.upper()):
        rows = bytes.fromhex(_DOTS.get(c, "1F11111111111F"))
        dots = np.array([[r >> (4 - k) & 1 for k in range(5)] for r in rows], bool).repeat(scale, 0).repeat(scale, 1)
        dy, dx = np.nonzero(dots)
        at_y, at_x = y - 7 * scale + dy, x + 6 * scale * i + dx
        ok = (0 <= at_y) & (at_y < h) & (0 <= at_x) & (at_x < w)
        image[at_y[ok], at_x[ok]] = colour


def white_page(width: int = 640, height: int = 480) -> np.ndarray:
    return np.full((height, width, 3), 255, np.uint8)


def gradient_page(width: int = 640, height: int = 480) -> np.ndarray:
    """Rows from black down, with three filled rectangles; for warm-ups."""
    page = np.repeat((255 * np.arange(height) / height).astype(np.uint8)[:, None, None], width, 1).repeat(3, 2)
    for k in range(3):
        page[height * (k + 1) // 5 : height * (k + 1) // 5 + height // 12, width // 10 : width // 2] = (255, 80 * k, 0)
    return page


def text_page(number: int = 1, width: int = 640, height: int = 480) -> np.ndarray:
    """A white page with three lines of text, for warm-ups of a model that reads."""
    page = white_page(width, height)
    for text, x, y, shade, scale in ((f"WARMUP-{number}", 150, 180, 0, 7), ("TEST-12345", 130, 280, 50, 6), ("ABCDEFGH", 160, 370, 80, 5)):
        write_text(page, text, x * width // 640, y * height // 480, (shade,) * 3, max(1, scale * width // 640))
    return page
