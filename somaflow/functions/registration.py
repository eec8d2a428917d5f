"""Registration and warping of images, in numpy: blocks of frames at once, and single ones as blocks of one."""

from __future__ import annotations

import numpy as np

from somaflow.functions import images


class Matcher:
    """Pearson correlation of an image's inside with each shifted window of frames ``most`` wider on every side."""

    def __init__(self, inner: np.ndarray, most: int):
        self.most, self.size = most, inner.size
        self.shape = tuple(n + 2 * most for n in inner.shape)
        inner = inner - inner.mean()
        self.norm = np.sqrt((inner**2).sum())
        self.fast = tuple(map(images.fast_size, self.shape))
        self.spectrum = np.conj(np.fft.rfft2(inner, self.fast))

    def _sums(self, block: np.ndarray) -> np.ndarray:
        """Sum over each window, from running sums."""
        h, w = (n - 2 * self.most for n in self.shape)
        s = np.zeros((len(block), block.shape[1] + 1, block.shape[2] + 1))
        s[:, 1:, 1:] = block.cumsum(axis=1).cumsum(axis=2)
        return s[:, h:, w:] - s[:, :-h, w:] - s[:, h:, :-w] + s[:, :-h, :-w]

    def __call__(self, block: np.ndarray) -> np.ndarray:
        block = block - block.mean(axis=(1, 2), keepdims=True)
        k = 2 * self.most + 1
        top = np.fft.irfft2(np.fft.rfft2(block, self.fast) * self.spectrum, self.fast)[:, :k, :k]
        square = block**2
        spread = self._sums(square) - self._sums(block) ** 2 / self.size
        # a window whose spread drowns in the rounding of the sums is constant
        known = (spread > 1e-12 * square.sum(axis=(1, 2))[:, None, None]) & (self.norm > 0)
        return np.where(known, top / np.where(known, np.sqrt(np.where(known, spread, 1)) * (self.norm or 1), 1), 0)


def ncc_maps(block: np.ndarray, template: np.ndarray, most: int) -> np.ndarray:
    """(frames, 2 most + 1, 2 most + 1): Pearson correlation of the template's inside with each shifted window."""
    h, w = template.shape
    return Matcher(template[most : h - most, most : w - most], most)(block)


#: Values of frames that are corrected together: many small frames, or one large one.
TOGETHER = 1 << 16


def _sub_pixel(lower: float, middle: float, upper: float) -> float:
    """Offset of a Gaussian's peak from three samples; 0 where their logarithms don't exist or don't bend."""
    if min(lower, middle, upper) <= 0:
        return 0.0
    a, b, c = np.log([lower, middle, upper])
    bend = 2 * a - 4 * b + 2 * c
    return float((a - c) / bend) if bend else 0.0


class Target:
    """A template made ready for many frames: its inside, and each of its patches, are filtered and transformed once."""

    def __init__(self, template: np.ndarray, params):
        from somaflow.operators.geometry import motion_patches

        self.template, self.params = template, params
        self.shape = template.shape
        self.rigid = rigid_matcher(template, params.max_deviation_rigid, params.filter_size)
        self.patches = motion_patches(*template.shape, params.strides, params.overlaps)
        #: By size of patch: their numbers, places and transforms; patches of a pixel's width aren't matched.
        self.groups: dict[tuple[int, int], tuple[list[int], list[tuple], np.ndarray]] = {}
        by_size: dict[tuple[int, int], list[int]] = {}
        for n, (_, y0, y1, x0, x1) in enumerate(self.patches):
            if y1 - y0 > 1 and x1 - x0 > 1:
                by_size.setdefault((y1 - y0, x1 - x0), []).append(n)
        for size, numbers in by_size.items():
            boxes = [self.patches[n][1:] for n in numbers]
            self.groups[size] = numbers, boxes, np.fft.fft2(self._cut(template, boxes))

    def _cut(self, image: np.ndarray, boxes: list[tuple]) -> np.ndarray:
        """The boxes of an image, each filtered by itself."""
        return images.band_pass(np.stack([image[y0:y1, x0:x1] for y0, y1, x0, x1 in boxes]), self.params.filter_size_patch)

    def shifts(self, image: np.ndarray) -> np.ndarray:
        """(patches, 2): the shift by which each patch of an image has to move onto the template's."""
        return self.block_shifts(image[None])[0]

    def block_shifts(self, block: np.ndarray) -> np.ndarray:
        """(frames, patches, 2): ``shifts`` of each frame."""
        out = np.zeros((len(block), len(self.patches), 2))
        for numbers, boxes, spectra in self.groups.values():
            for n, (y0, y1, x0, x1), spectrum in zip(numbers, boxes, spectra):
                part = np.fft.fft2(images.band_pass(block[:, y0:y1, x0:x1], self.params.filter_size_patch))
                out[:, n] = -_registered(part, spectrum, self.params.upsample_factor, self.params.max_shifts)[0]
        return out


def rigid_matcher(template: np.ndarray, most: int, scale: int) -> Matcher:
    """Matches frames with the template's inside, which is cut first and band-pass filtered then."""
    h, w = template.shape
    return Matcher(images.band_pass(template[None, most : h - most, most : w - most], scale)[0], most)


def rigid_shift(image: np.ndarray, matcher: Matcher, scale: int) -> tuple[float, float]:
    """Sub-pixel shift that moves ``image``, band-pass filtered, onto the matcher's template."""
    return tuple(rigid_shifts(image[None], matcher, scale)[0].tolist())


def rigid_shifts(block: np.ndarray, matcher: Matcher, scale: int) -> np.ndarray:
    """(frames, 2): ``rigid_shift`` of each frame."""
    most = matcher.most
    maps = matcher(images.band_pass(block, scale))
    out = np.zeros((len(block), 2))
    for n, (r, best) in enumerate(zip(maps, maps.reshape(len(block), -1).argmax(axis=1).tolist())):
        y, x = divmod(best, r.shape[1])
        dy = dx = 0.0
        if 0 < y < 2 * most - 1 and 0 < x < 2 * most - 1:
            dy, dx = _sub_pixel(r[y - 1, x], r[y, x], r[y + 1, x]), _sub_pixel(r[y, x - 1], r[y, x], r[y, x + 1])
        out[n] = -(y - most + dy), -(x - most + dx)
    return out


def _cubic(t: np.ndarray) -> np.ndarray:
    """Weights of the four samples around an offset in [0, 1); Keys' kernel with a = -0.75."""
    a = -0.75
    d = np.abs(t[..., None] - np.arange(-1, 3))
    near = ((a + 2) * d - (a + 3)) * d * d + 1
    far = ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return np.where(d <= 1, near, np.where(d < 2, far, 0))


def _linear(t: np.ndarray) -> np.ndarray:
    return np.stack((np.zeros_like(t), 1 - t, t, np.zeros_like(t)), axis=-1)


def _sampling(n: int, shift: float, weights) -> np.ndarray:
    """(n, n) matrix that moves a row of samples by ``shift``, the border reflected."""
    at = np.arange(n) - shift
    base = np.floor(at).astype(int)
    k = weights(at - base)
    out = np.zeros((n, n))
    for j in range(4):
        i = np.mod(base + j - 1, 2 * n)
        np.add.at(out, (np.arange(n), np.where(i < n, i, 2 * n - 1 - i)), k[:, j])
    return out


def _samplings(n: int, shifts: np.ndarray, weights) -> np.ndarray:
    """(frames, n, n): ``_sampling`` for each frame's shift; equal shifts share their matrix."""
    each, which = np.unique(shifts, return_inverse=True)
    return np.stack([_sampling(n, shift, weights) for shift in each])[which]


def translate(image: np.ndarray, shift: tuple[float, float], cubic: bool = True, clip: bool = True, border_nan: bool = False) -> np.ndarray:
    """``image`` moved by (rows, columns); values stay in the image's range.

    With ``border_nan`` what comes in from outside takes the mean of the rest.
    """
    return translated(image[None], np.array([shift], float), cubic, clip, border_nan)[0]


def translated(block: np.ndarray, shifts: np.ndarray, cubic: bool = True, clip: bool = True, border_nan: bool = False) -> np.ndarray:
    """``translate`` of each frame by its own shift (frames, 2)."""
    if not len(block):
        return np.zeros(block.shape)
    kind = _cubic if cubic else _linear
    out = _samplings(block.shape[1], shifts[:, 0], kind) @ block @ _samplings(block.shape[2], shifts[:, 1], kind).transpose(0, 2, 1)
    if clip:
        out = np.clip(out, block.min(axis=(1, 2), keepdims=True), block.max(axis=(1, 2), keepdims=True))
    if border_nan:
        # frames whose borders are equally wide have the same rest
        wide, which = np.unique((np.ceil(np.abs(shifts)) * np.where(shifts >= 0, 1, -1)).astype(int), axis=0, return_inverse=True)
        for n, (sy, sx) in enumerate(wide.tolist()):
            frames = np.flatnonzero(which.ravel() == n)
            gone = np.zeros(out.shape[1:], bool)
            gone[: max(sy, 0)], gone[out.shape[1] + min(sy, 0) :] = True, True
            gone[:, : max(sx, 0)], gone[:, out.shape[2] + min(sx, 0) :] = True, True
            if gone.any():
                rest = out[frames][:, ~gone]
                out[np.ix_(frames, *map(np.arange, gone.shape))] = np.where(gone, rest.mean(axis=1)[:, None, None] if rest.size else 0.0, out[frames])
    return out


def cross_correlation(block: np.ndarray, template: np.ndarray, most: tuple[int, int] | None = None) -> np.ndarray:
    """Absolute circular cross-correlation by offset, zero beyond rows -m .. m - 1 and columns alike."""
    return _near(np.abs(np.fft.ifft2(np.fft.fft2(block, axes=(-2, -1)) * np.conj(np.fft.fft2(template)), axes=(-2, -1))), most)


def _near(r: np.ndarray, most: tuple[int, int] | None) -> np.ndarray:
    if most is not None:
        for axis, m in ((-2, most[0]), (-1, most[1])):
            n = r.shape[axis]
            if 2 * m < n:
                cut = [slice(None)] * r.ndim
                cut[axis] = slice(m, n - m)
                r[tuple(cut)] = 0
    return r


def _upsampled(product: np.ndarray, size: int, factor: int, offset: np.ndarray) -> np.ndarray:
    """Each frame's cross-correlation around its ``offset`` (frames, 2), ``factor`` times finer, by two small matrix products."""
    out = product
    for axis, n in enumerate(product.shape[1:]):
        k = np.fft.ifftshift(np.arange(n)) - n // 2
        phase = np.exp(-2j * np.pi / (n * factor) * ((np.arange(size) - offset[:, axis, None])[:, :, None] * k))
        out = phase @ out if axis == 0 else out @ phase.transpose(0, 2, 1)
    return out


def register(image: np.ndarray, template: np.ndarray, factor: int = 1, most: tuple[int, int] | None = None) -> tuple[np.ndarray, float, float]:
    """(shift, error, phase): shift of ``image`` against ``template`` to 1 / factor of a pixel.

    The error is the root of the normalised mismatch, the phase that of the peak.
    """
    shift, error, phase = _registered(np.fft.fft2(image)[None], np.fft.fft2(template), factor, most)
    return shift[0], float(error[0]), float(phase[0])


def _registered(a: np.ndarray, b: np.ndarray, factor: int, most: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``register`` of the Fourier transforms of a block of frames and of a template."""
    product, every = a * np.conj(b), np.arange(len(a))
    whole = np.fft.ifft2(product)
    r = _near(np.abs(whole), most)
    peak = np.stack(np.unravel_index(r.reshape(len(r), -1).argmax(axis=1), r.shape[1:]), axis=1)
    shape = np.array(a.shape[1:])
    shift = np.where(peak > shape // 2, peak - shape, peak).astype(float)
    top, energy = whole[every, peak[:, 0], peak[:, 1]], np.sqrt((np.abs(a) ** 2).sum(axis=(1, 2)) * (np.abs(b) ** 2).sum()) / b.size
    if factor > 1:
        shift = np.round(shift * factor) / factor
        size = int(np.ceil(1.5 * factor))
        middle = size // 2
        fine = _upsampled(np.conj(product), size, factor, middle - shift * factor).conj()
        at = np.stack(np.unravel_index(np.abs(fine).reshape(len(fine), -1).argmax(axis=1), fine.shape[1:]), axis=1)
        top = fine[every, at[:, 0], at[:, 1]] / b.size
        shift = shift + (at - middle) / factor
    shift = np.where(shape == 1, 0, shift)
    error = np.where(energy > 0, np.sqrt(np.maximum(0.0, 1 - (np.abs(top) / np.where(energy > 0, energy, 1)) ** 2)), 0.0)
    return shift, error, np.arctan2(top.imag, top.real)


def resize_field(field: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A shift field on a finer grid, cubic, the edge repeated."""
    out = field
    for axis, n in enumerate(shape):
        size = field.shape[axis]
        if n != size:
            at = (np.arange(n) + 0.5) * size / n - 0.5
            base = np.floor(at).astype(int)
            k = _cubic(at - base)
            rows = np.stack([np.take(out, np.clip(base + j - 1, 0, size - 1), axis=axis) for j in range(4)], axis=-1)
            k = k[:, None, :] if axis == 0 else k[None, :, :]
            out = (rows * k).sum(axis=-1)
    return out


def _ramp(n: int, overlap: int, first: bool, last: bool) -> np.ndarray:
    """Weights along one axis: rising and falling over the overlaps, full at the image's border."""
    out, k = np.ones(n), min(overlap, n)
    up = np.linspace(0, 1, overlap)[:k] if overlap else np.zeros(0)
    if not first:
        out[:k] = up
    if not last:
        out[n - k :] = np.minimum(out[n - k :], up[::-1])
    return out


def shear(field: np.ndarray) -> np.ndarray:
    """Upper quartile of the largest steps between patches, of both shifts along both axes; fields (..., rows, columns, 2)."""
    steps = [np.abs(np.diff(field[..., k], axis=a)).max(axis=(-2, -1), initial=0) for k in range(2) for a in (-2, -1)]
    return np.percentile(steps, 75, axis=0)


def join_patches(image: np.ndarray, parts: list[np.ndarray], corners: list[tuple[int, int]], overlaps: tuple[int, int], gentle: bool) -> np.ndarray:
    """One image of moved patches, which stand in reading order at their corners (y, x).

    Gentle ones are blended over the overlaps, NaN left out, with ``image`` as
    one more layer; others are pasted onto it, each without half its overlaps.
    Pixels without any value take the median of the rest.
    """
    return _joined(image[None], [part[None] for part in parts], corners, overlaps, gentle)[0]


def _joined(block: np.ndarray, parts: list[np.ndarray], corners: list[tuple[int, int]], overlaps: tuple[int, int], gentle: bool) -> np.ndarray:
    """``join_patches`` of each frame; every part is a block."""
    h, w = block.shape[1:]
    oy, ox = overlaps
    total, weight = block.astype(float).copy(), np.ones(block.shape)
    for part, (y, x) in zip(parts, corners):
        below, right = y + part.shape[1], x + part.shape[2]
        if gentle:
            ramp = np.outer(_ramp(below - y, oy, y == 0, below == h), _ramp(right - x, ox, x == 0, right == w))
            ok = np.isfinite(part)
            total[:, y:below, x:right] += np.where(ok, part, 0) * ramp
            weight[:, y:below, x:right] += ramp * ok
        else:
            ty, tx = (0 if y == 0 else oy // 2), (0 if x == 0 else ox // 2)
            total[:, y + ty : below, x + tx : right] = part[:, ty:, tx:]
    out = total / weight
    bad = ~np.isfinite(out)
    for n in np.flatnonzero(bad.any(axis=(1, 2))):
        out[n][bad[n]] = np.median(out[n][~bad[n]]) if (~bad[n]).any() else 0.0
    return out


def piecewise_correct(image: np.ndarray, target: Target) -> np.ndarray:
    """The image with every patch moved by its own shift; what comes into a patch from outside takes the mean of its rest.

    Fields with a shear under half a pixel are blended, others pasted.
    """
    return piecewise_corrected(image[None], target)[0]


def piecewise_corrected(block: np.ndarray, target: Target) -> np.ndarray:
    """``piecewise_correct`` of each frame."""
    params, patches, shifts = target.params, target.patches, target.block_shifts(block)
    out = block.copy()
    moving = np.flatnonzero(shifts.any(axis=(1, 2)))
    if not len(moving):
        return out
    h, w = block.shape[1:]
    sy, sx = params.strides
    rows, cols = -(-h // sy), -(-w // sx)
    field = shifts[moving].reshape(len(moving), rows, cols, 2)
    if (u := params.upsample_factor_grid) > 1:
        from somaflow.operators.geometry import motion_patches

        sy, sx = (max(1, int(np.round(s / u))) for s in (sy, sx))
        patches = motion_patches(h, w, (sy, sx), params.overlaps)
        rows, cols = -(-h // sy), -(-w // sx)
        field = np.stack([np.stack([resize_field(f[..., k], (rows, cols)) for k in range(2)], axis=-1) for f in field])
    gentle = shear(field) < 0.5
    for kind in (True, False):
        frames = moving[gentle == kind]
        if not len(frames):
            continue
        parts = []
        for n, (_, y0, y1, x0, x1) in enumerate(patches):
            part, shift = block[frames, y0:y1, x0:x1], field[gentle == kind, n // cols, n % cols]
            moved = np.flatnonzero(shift.any(axis=1))
            part[moved] = translated(part[moved], shift[moved], border_nan=True)
            parts.append(part)
        out[frames] = _joined(block[frames], parts, [(y0, x0) for _, y0, _, x0, _ in patches], params.overlaps, kind)
    return out


def correct_frame(image: np.ndarray, target: Target) -> np.ndarray:
    """Rigid, then piecewise."""
    return correct_block(image[None], target)[0]


def correct_block(block: np.ndarray, target: Target) -> np.ndarray:
    """``correct_frame`` of each frame; as many are corrected at once as have TOGETHER values."""
    step = max(1, TOGETHER // max(1, block[0].size)) if len(block) else 1
    done = [piecewise_corrected(translated(b, rigid_shifts(b, target.rigid, target.params.filter_size), cubic=False), target) for b in (block[a : a + step] for a in range(0, len(block), step))]
    return np.concatenate(done) if done else block.astype(float)
