"""Image kernels in numpy over blocks of frames (frames, rows, columns)."""

from __future__ import annotations

import numpy as np


def gaussian(size: int, sigma: float) -> np.ndarray:
    """Normalised samples of a Gaussian around the middle of ``size`` places."""
    i = np.arange(size) - (size - 1) / 2
    g = np.exp(-(i**2) / (2 * sigma**2))
    return g / g.sum()


def kernel_size(scale: int) -> int:
    return 3 * scale // 2 * 2 + 1


def disc_kernel(scale: int) -> np.ndarray:
    """Zero-mean Gaussian disc: entries below the largest of the first column are zero."""
    g = gaussian(kernel_size(scale), scale)
    k = np.outer(g, g)
    inside = k >= k[:, 0].max()
    return np.where(inside, k - k[inside].mean(), 0)


def border_index(n: int, reach: int, border: str) -> np.ndarray:
    """Source index of each place from -reach to n + reach - 1."""
    i = np.arange(-reach, n + reach)
    if border == "replicate":
        return np.clip(i, 0, n - 1)
    if border == "reflect":  # edge repeated: -1 is 0
        i = np.mod(i, 2 * n)
        return np.where(i < n, i, 2 * n - 1 - i)
    raise ValueError(border)


#: Kernels of more places than this are applied by Fourier transforms.
DIRECT = 144


def fast_size(n: int) -> int:
    """The least size from ``n`` on whose only prime factors are 2, 3 and 5."""
    while True:
        m = n
        for p in (2, 3, 5):
            while m % p == 0:
                m //= p
        if m == 1:
            return n
        n += 1


def correlate(block: np.ndarray, kernel: np.ndarray, border: str) -> np.ndarray:
    """Each frame correlated with an odd-sized kernel."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    h, w = block.shape[1:]
    padded = block[:, border_index(h, ry, border)][:, :, border_index(w, rx, border)]
    if kernel.size > DIRECT:
        size = (fast_size(h + 2 * ry), fast_size(w + 2 * rx))
        spectrum = np.conj(np.fft.rfft2(kernel, size))
        return np.stack([np.fft.irfft2(np.fft.rfft2(f, size) * spectrum, size)[:h, :w] for f in padded]) if len(block) else np.zeros(block.shape)
    out = np.zeros(block.shape)
    for (i, j), weight in np.ndenumerate(kernel):
        if weight:
            out += weight * padded[:, i : i + h, j : j + w]
    return out


def band_pass(block: np.ndarray, scale: int) -> np.ndarray:
    return correlate(block, disc_kernel(scale), "reflect")


def centred_gaussian(block: np.ndarray, sigma: int, center: bool = True, border: str = "replicate") -> np.ndarray:
    """Gaussian blur, less the box average of the same size if ``center``."""
    size = kernel_size(sigma)
    g = gaussian(size, sigma)
    k = np.outer(g, g)
    return correlate(block, k - 1 / size**2 if center else k, border)


def median3(image: np.ndarray) -> np.ndarray:
    """Median of 3 x 3 with the edge repeated."""
    h, w = image.shape
    p = image[border_index(h, 1, "reflect")][:, border_index(w, 1, "reflect")]
    return np.median(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0)


def _morph(mask: np.ndarray, pad: bool, pick) -> np.ndarray:
    h, w = mask.shape
    p = np.pad(mask, 1, constant_values=pad)
    return pick(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0)


def closing(mask: np.ndarray) -> np.ndarray:
    """Dilation, then erosion, by 3 x 3; outside counts as empty in both."""
    return _morph(_morph(mask.astype(bool), False, np.any), False, np.all)


def dilate(mask: np.ndarray) -> np.ndarray:
    """Pixels within a diamond of radius 2 of a pixel that is set."""
    h, w = mask.shape
    p, out = np.pad(mask.astype(bool), 2), np.zeros((h, w), bool)
    for dy in range(-2, 3):
        for dx in range(-2 + abs(dy), 3 - abs(dy)):
            out |= p[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w]
    return out


def label(mask: np.ndarray) -> np.ndarray:
    """Numbers (from 1) of the 8-connected regions, in reading order of their first pixels; 0 outside."""
    h, w = mask.shape
    number = np.where(mask, np.arange(1, h * w + 1).reshape(h, w), 0)
    while True:
        p, best = np.pad(number, 1, constant_values=0), number
        for i in range(3):
            for j in range(3):
                n = p[i : i + h, j : j + w]
                best = np.where(mask & (n > 0), np.minimum(best, n), best)
        if (best == number).all():
            break
        number = best
    return np.searchsorted(np.unique(number[mask]), number) * mask + mask


def area_down(block: np.ndarray, s: int, t: int) -> np.ndarray:
    """Mean over s x s pixels and t frames; what doesn't fill a cell is left out."""
    n, h, w = block.shape[0] // t, block.shape[1] // s, block.shape[2] // s
    return block[: n * t, : h * s, : w * s].reshape(n, t, h, s, w, s).mean(axis=(1, 3, 5))


def linear_up(block: np.ndarray, h: int, w: int) -> np.ndarray:
    """Images resized by linear interpolation between pixel centres, the edge repeated."""
    out = block
    for axis, n in ((1, h), (2, w)):
        size = block.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * size / n - 0.5, 0, size - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape((-1, 1) if axis == 1 else (-1,))
        out = np.take(out, low, axis) * (1 - part) + np.take(out, np.minimum(low + 1, size - 1), axis) * part
    return out


def center_of_mass(image: np.ndarray) -> np.ndarray:
    total = image.sum()
    return np.array([(image * i).sum() / total for i in np.indices(image.shape)])


def circular_constraint(image: np.ndarray) -> np.ndarray:
    """Keeps what falls off from the peak: pixels below half of it whose gradient points away go,
    and of the rest the region that the peak's own, grown by one pixel, belongs to."""
    out = np.where(image < 0, 0, image).astype(float)
    rows, cols = np.nonzero(out > 0)
    if not len(rows):
        return out
    y0, y1, x0, x1 = rows.min(), rows.max() + 1, cols.min(), cols.max() + 1
    box = out[y0:y1, x0:x1]
    if min(box.shape) > 1:
        peak = np.array(np.unravel_index(box.argmax(), box.shape))
        dy, dx = np.gradient(box)
        iy, ix = np.indices(box.shape)
        outward = dy * (peak[0] - iy) + dx * (peak[1] - ix)
        box = np.where((outward < 0) & (box < box.max() / 2), 0, box)
        regions = label(box > 0)
        own = regions == regions[tuple(peak)]
        box = np.where(_morph(own, False, np.any), box, 0)
    out = np.zeros_like(out)
    out[y0:y1, x0:x1] = box
    return out
