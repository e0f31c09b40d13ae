"""Signal kernels in numpy, in three shapes.

Frame kernels take a matrix of frames (rows) and the rate, block kernels the frames of one block and the hop, wave
kernels one whole wave; they give a row for each frame, or a sample for each sample. None keeps state, so Spark may
deal frames, blocks and waves over tasks as it likes. Silent input gives zeros (logarithms: of their floor), never NaN.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CEPSTRA, BANDS = 13, 21

#: Added to denominators and logarithms; fixed values.
TINY, LOG_FLOOR = 1e-10, 1e-5


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """All full frames as rows."""
    n = (len(x) - size) // hop + 1 if len(x) >= size else 0
    return x[np.arange(size) + hop * np.arange(n)[:, None]] if n else np.zeros((0, size))


def joined(fr: np.ndarray, hop: int) -> np.ndarray:
    """The stretch of the wave that consecutive frames cover (hop at most their size)."""
    return np.concatenate([fr[:-1, :hop].ravel(), fr[-1]])


def cosines(m: int, n: int, orthonormal: bool = True) -> np.ndarray:
    """n x m basis of the DCT-II; not orthonormal: each coefficient is twice the sum of products."""
    basis = np.cos(np.pi / m * (np.arange(m) + 0.5) * np.arange(min(n, m))[:, None])
    if not orthonormal:
        return 2 * basis
    return basis * np.where(np.arange(len(basis)) == 0, np.sqrt(1 / m), np.sqrt(2 / m))[:, None]


def dct(x: np.ndarray, n: int = CEPSTRA) -> np.ndarray:
    """The first n coefficients of the orthonormal DCT-II of each row."""
    return x @ cosines(x.shape[1], n).T


# Spectra. Magnitudes are taken under a periodic Hann window.


def magnitudes(fr: np.ndarray, nfft: int | None = None) -> np.ndarray:
    n = fr.shape[1]
    return np.abs(np.fft.rfft(fr * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)), nfft or n))


def triangles(edge: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Triangles of area 1 over neighbouring edges, at the frequencies f."""
    up = (f - edge[:-2, None]) / np.diff(edge)[:-1, None]
    down = (edge[2:, None] - f) / np.diff(edge)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edge[2:] - edge[:-2]))[:, None]


def slaney_edges(bands: int, fs: float) -> np.ndarray:
    """bands + 2 frequencies up to fs / 2, even on a scale that's linear to 1000 Hz and logarithmic above."""
    step, knee, ratio = 200 / 3, 1000.0, np.log(6.4) / 27
    top = fs / 2 / step if fs / 2 < knee else knee / step + np.log(fs / 2 / knee) / ratio
    mel = np.linspace(0, top, bands + 2)
    return np.where(mel < knee / step, mel * step, knee * np.exp(ratio * (mel - knee / step)))


def mel_power(fr: np.ndarray, fs: float, bands: int = BANDS) -> np.ndarray:
    n = fr.shape[1]
    return magnitudes(fr) ** 2 @ triangles(slaney_edges(bands, fs), np.linspace(0, fs / 2, n // 2 + 1)).T


def log_mel(fr: np.ndarray, fs: float, bands: int = BANDS) -> np.ndarray:
    """Decibels of mel_power, from -100 on."""
    return 10 * np.log10(np.maximum(mel_power(fr, fs, bands), 1e-10))


def log_mel_sum(fr: np.ndarray, fs: float, bands: int = BANDS, first: int = 18) -> np.ndarray:
    """Sum of the logarithms of the first bands' powers."""
    return np.log10(np.maximum(mel_power(fr, fs, bands)[:, :first], 1e-10)).sum(1, keepdims=True)


def peak_scaled(fr: np.ndarray, fs: float) -> np.ndarray:
    """Magnitudes of the frame without window, padded to twice its size, over their peak."""
    s = np.abs(np.fft.rfft(fr, 2 * fr.shape[1]))[:, : fr.shape[1]]
    return s / (s.max(1, keepdims=True) + TINY)


def spectral_shape(fr: np.ndarray, fs: float) -> np.ndarray:
    """Centroid, and the least frequency up to which 0.8 of the magnitude lies."""
    s = magnitudes(fr)
    f = np.linspace(0, fs / 2, s.shape[1])
    total = s.sum(1)
    below = (np.cumsum(s, 1) < 0.8 * total[:, None]).sum(1)
    return np.stack([s @ f / np.maximum(total, TINY), f[np.minimum(below, len(f) - 1)]], 1)


def chroma_bank(fs: float, nfft: int, bins: int) -> np.ndarray:
    """bins x (nfft // 2 + 1): bumps round each pitch class (the first is C; A = 440 Hz), weighted by nearness to octave 5.

    Columns have norm 1 before the weight. The constant part counts as one and a half octaves below the first bin.
    """
    pitch = bins * np.log2(np.arange(1, nfft) * fs / nfft / 27.5)
    pitch = np.concatenate([[pitch[0] - 1.5 * bins], pitch])
    width = np.concatenate([np.maximum(np.diff(pitch), 1), [1]])
    half = round(bins / 2)
    off = (pitch - np.arange(bins)[:, None] + half) % bins - half
    bump = np.exp(-2 * (off / width) ** 2)
    bump /= np.sqrt((bump**2).sum(0))
    bump *= np.exp(-0.5 * ((pitch / bins - 5) / 2) ** 2)
    return np.roll(bump, -3 * (bins // 12), 0)[:, : nfft // 2 + 1]


def chroma(fr: np.ndarray, fs: float, bins: int = 36) -> np.ndarray:
    """Power by pitch class over the largest."""
    c = magnitudes(fr) ** 2 @ chroma_bank(fs, fr.shape[1], bins).T
    return c / np.maximum(c.max(1, keepdims=True), TINY)


def chroma_change(fr: np.ndarray, fs: float, bins: int = 36) -> np.ndarray:
    """Squared steps between neighbouring pitch classes, summed, and the power in bins 6 to 17 of their padded spectrum.

    The last class is compared with class 1, not 0.
    """
    c = chroma(fr, fs, bins)
    after = np.concatenate([c[:, 1:], c[:, 1:2]], 1)
    high = np.abs(np.fft.fft(c, 2 * bins))[:, 6:18] ** 2
    return np.stack([((c - after) ** 2).sum(1), high.sum(1)], 1)


def zero_crossings(fr: np.ndarray, fs: float) -> np.ndarray:
    return (np.diff(fr < 0, axis=1).sum(1) / fr.shape[1])[:, None]


def energy(fr: np.ndarray, fs: float) -> np.ndarray:
    return (fr**2).mean(1, keepdims=True)


def mean(fr: np.ndarray, fs: float) -> np.ndarray:
    return fr.mean(1, keepdims=True)


def autocorrelation_peak(fr: np.ndarray, fs: float, least: int = 16) -> np.ndarray:
    """Height of the highest peak of each frame's autocorrelation (1 at lag 0) among lags > ``least``, its period, its pitch.

    A plateau counts at its middle. Without a peak, what stands at lag ``least`` is taken; frames of that many samples or fewer
    give zeros.
    """
    k, n = fr.shape
    if n <= least:
        return np.zeros((k, 3))
    r = np.fft.irfft(np.abs(np.fft.rfft(fr, 2 * n)) ** 2, 2 * n)[:, :n]
    r = r / (r[:, :1] + TINY)
    out = np.zeros((k, 3))
    for row, v in enumerate(r[:, least:]):
        at = peaks(v)
        lag = at[v[at].argmax()] if len(at) else 0
        out[row] = v[lag], (lag + least) / fs, fs / (lag + least)
    return out


def peaks(v: np.ndarray) -> np.ndarray:
    """Places of the local maxima inside v; of a flat top its middle, rounded down."""
    turn = np.flatnonzero(np.diff(v)) + 1  # first places of runs of equal values, but for the first
    first, last = turn[:-1], turn[1:] - 1
    high = (v[first] > v[first - 1]) & (v[first] > v[turn[1:]]) if len(first) else np.zeros(0, bool)
    return (first[high] + last[high]) // 2


# Group delay.


def group_delay(fr: np.ndarray, nfft: int) -> tuple[np.ndarray, np.ndarray]:
    """The group delay's numerator and the magnitude, on the bins of an rfft."""
    a, b = np.fft.rfft(fr, nfft), np.fft.rfft(fr * np.arange(fr.shape[1]), nfft)
    return a.real * b.real + a.imag * b.imag, np.abs(a)


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal of each row."""
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=-1) * gain, axis=-1)


def zero_time(fr: np.ndarray) -> tuple[np.ndarray, int]:
    """Frames under the zero-time window, and the size of their transforms."""
    size = fr.shape[1]
    turn = np.cos(np.pi * np.arange(size) / size)
    pole = np.divide(0.5, 1 - turn, out=np.zeros(size), where=turn < 1)
    return fr * 2 * (1 + turn) * pole**2, 2 << (size - 1).bit_length() if size > 1 else 2


def delay_family(fr: np.ndarray, fs: float, power: float = 0.5) -> dict[str, np.ndarray]:
    """The group delays of zero-time windowed frames, on the bins from 0 to half the rate.

    ngd: the numerator; mag: the magnitude, its zeros raised to the least other one of the frame; gd: (ngd / mag) ** 2; mgd: (abs(ngd) / mag) ** power, both with 1e-10 added to the magnitude;
    dngd, dgd: their second differences along the circle of frequencies, negative; hngd, hgd: the envelopes of the third ones. Circles are repeated three times; differences are taken from
    two places before the middle's start, envelopes from four. Silent frames are zeros.
    """
    windowed, nfft = zero_time(fr)
    ngd, mag = group_delay(windowed, nfft)
    least = np.where(mag > 0, mag, np.inf).min(1, keepdims=True)
    sound = np.isfinite(least)
    mag = np.where(mag > 0, mag, np.where(sound, least, 0))
    out = {"ngd": ngd, "mag": mag, "gd": (ngd / (mag + 1e-10)) ** 2, "mgd": (np.abs(ngd) / (mag + 1e-10)) ** power}
    bins = nfft // 2 + 1
    for name in ("ngd", "gd"):
        rounds = np.tile(np.concatenate([out[name], out[name][:, -2:0:-1]], 1), 3)
        out[f"d{name}"] = -np.diff(rounds, n=2, axis=1)[:, nfft - 2 : nfft - 2 + bins]
        out["h" + name] = np.abs(analytic(np.diff(rounds, n=3, axis=1)))[:, nfft - 4 : nfft - 4 + bins]
    return {k: np.where(sound, v, 0.0) for k, v in out.items()}


def hngd(fr: np.ndarray, fs: float) -> np.ndarray:
    """Envelopes of the differenced group-delay numerator of zero-time windowed frames, from the highest frequency down.

    The numerator is circular, so it's repeated three times and the middle is taken, from four places before its start.
    """
    windowed, nfft = zero_time(fr)
    top, _ = group_delay(windowed, nfft)
    circle = np.concatenate([top, top[:, -2:0:-1]], 1)
    envelope = np.abs(analytic(np.diff(np.tile(circle, 3), n=3, axis=1)))
    return envelope[:, nfft - 4 : nfft - 4 + nfft // 2][:, ::-1]


def hngd_cepstra(fr: np.ndarray, fs: float, bands: int = BANDS, n: int = CEPSTRA) -> np.ndarray:
    """Liftered cosine sums of the logarithms of hngd's energies in triangles, over its first half.

    Edges are even on 1127 ln(1 + f / 700), a step of 1 / (bands + 2) of the range apart. The cosines' argument is
    k * (pi * m - 0.5) / bands.
    """
    spectrum = hngd(fr, fs)
    k = spectrum.shape[1] // 2 + 1
    step = np.log(1 + fs / 2 / 700) / (bands + 2)
    bank = triangles(700 * np.expm1(step * np.arange(bands + 2)), np.linspace(0, fs / 2, k))
    basis = np.sqrt(2 / bands) * np.cos(np.arange(n)[:, None] * (np.pi * np.arange(1, bands + 1) - 0.5) / bands)
    lifter = 1 + bands / 2 * np.sin(np.pi * np.arange(n) / bands)
    return np.log(spectrum[:, :k] @ bank.T + LOG_FLOOR) @ basis.T * lifter


# Blocks of frames: what is scaled or filtered over the block depends on which frames are in it.


def median5(x: np.ndarray) -> np.ndarray:
    """Median of the 5 x 5 places round each, mirrored at the borders."""
    wide = np.pad(x, 2, "symmetric")
    around = np.lib.stride_tricks.sliding_window_view(wide, (5, 5)).reshape(*x.shape, 25)
    around.partition(12, axis=2)
    return around[:, :, 12]


def modified_group_delays(blocks: list[np.ndarray], grid: list[tuple[float, float]], n: int = CEPSTRA, nfft: int = 512, smooth: int = 30) -> Iterator[tuple[int, np.ndarray]]:
    """For each (rho, gamma) of the grid its number and, of the blocks' frames one after another, the DCT-II of the first n values, from the
    highest frequency down, of the modified group delay over its block's largest value.

    The denominator is the spectrum smoothed by a median and by keeping ``smooth`` cosine coefficients. Frames longer than nfft
    are cut to it. Settings come by gamma: what it alone decides is made once for all its rhos.
    """
    top, size = group_delay(np.concatenate(blocks)[:, :nfft], nfft)
    many = np.array([len(x) for x in blocks])
    first = np.cumsum(many) - many
    basis = cosines(size.shape[1], smooth)
    log = np.log(np.maximum(size, TINY))
    log = np.concatenate([median5(x) for x in np.split(log, first[1:])]) @ basis.T @ basis
    cepstra = cosines(n, n, False)[:, : size.shape[1]].T
    for gamma in dict.fromkeys(g for _, g in grid):
        tau = top / (np.exp(2 * gamma * log) + TINY)
        most = np.repeat(np.maximum.reduceat(np.abs(tau).max(1), first), many)[:, None]
        tau = tau[:, ::-1][:, :n]
        for number, (rho, own) in enumerate(grid):
            if own == gamma:  # a power keeps the order of sizes, so the largest value's is the largest
                yield number, (np.sign(tau) * np.abs(tau) ** rho / (most**rho + TINY)) @ cepstra


def modified_group_delay(fr: np.ndarray, fs: float, hop: int, rho: float = 0.1, gamma: float = 0.3) -> np.ndarray:
    return next(modified_group_delays([fr], [(rho, gamma)]))[1]


def instantaneous_frequency(fr: np.ndarray, fs: float, hop: int, bands: int = 128, n: int = CEPSTRA) -> np.ndarray:
    """DCT-II of the first n values, from the highest band down, of the bands' mean frequencies less their own centre.

    Bands are Gaussian, one band wide, centred one band below their number; running sums over a frame and one more sample smooth
    the products. The wave isn't dithered: ``dithered`` does that, with a seed. Only the bands that are given out are made.
    """
    k, size = fr.shape
    x = joined(fr, hop) * 2**15
    many = len(x)
    half = many // 2 + 1
    spectrum = np.fft.fft(x)[:half]
    bins, step = np.arange(half), 1 / (bands - 1)
    first = max(0, bands - n)
    out = np.zeros((k, bands - first))
    at = hop * np.arange(k)
    for b in range(first, bands):
        own = spectrum * np.exp(-0.5 * ((bins / max(half - 1, 1) - (b - 1) * step) / step) ** 2)
        z, dz = np.fft.ifft(own, many), np.fft.ifft(own * bins, many)
        top, under = (np.convolve(v, np.ones(size + 1))[:many] for v in ((z.conj() * dz).real, np.abs(z) ** 2))
        centre = (np.round(b * step * half) - 1) / many * 2 * np.pi
        smooth = top / (under + TINY) * (2 * np.pi / many) - centre
        out[:, b - first] = smooth[at[:, None] + np.arange(size)] @ np.hamming(size)
    return out[:, ::-1] @ cosines(n, n, False)[:, : out.shape[1]].T


# Whole waves.


def dithered(x: np.ndarray, seed: int, bits: int = 16) -> np.ndarray:
    """x with triangular noise of one step of a bits-bit signal, the same for the same seed."""
    r = np.random.default_rng(seed)
    return x + (r.random(len(x)) - r.random(len(x))) / 2 ** (bits - 1)


def trend_freed(y: np.ndarray, window: int) -> np.ndarray:
    """y less its mean over [i - window // 2, i + (window - 1) // 2], as far as there are samples."""
    total = np.concatenate([[0.0], np.cumsum(y)])
    i = np.arange(len(y))
    a, b = np.maximum(i - window // 2, 0), np.minimum(i + (window - 1) // 2 + 1, len(y))
    return y - (total[b] - total[a]) / np.maximum(b - a, 1)


def zero_frequency(x: np.ndarray, fs: float, ms: float = 16) -> np.ndarray:
    """Four running sums of the step to the next sample (the last one twice; over its peak), each freed of its trend over ms.

    Two windows at both ends, where the trend isn't known, are zero.
    """
    window = round(ms * fs / 1000)
    y = np.diff(x)
    y = np.append(y, y[-1:] if len(y) else 0.0)[: len(x)]
    y = y / (np.abs(y).max(initial=0) + TINY)
    for _ in range(4):
        y = np.cumsum(y)
    for _ in range(4):
        y = trend_freed(y, window)
    y[: 2 * window] = 0
    y[max(len(y) - 2 * window, 0) :] = 0
    return y


def zero_frequency_wave(x: np.ndarray, fs: float, size: int, hop: int) -> np.ndarray:
    """zero_frequency of the wave over its peak, over its own peak."""
    z = zero_frequency(x / (1.01 * np.abs(x).max() + TINY), fs)
    return z / (np.abs(z).max() + TINY)


def burg(x: np.ndarray, order: int) -> np.ndarray:
    """Burg's predictor, 1 first; of a silent or too short row zeros after it."""
    f, b, a = x[1:].astype(float), x[:-1].astype(float), np.array([1.0])
    for _ in range(order):
        power = f @ f + b @ b
        r = -2 * (f @ b) / power if power > 0 else 0.0
        a = np.append(a, 0) + r * np.append(a, 0)[::-1]
        f, b = (f + r * b)[1:], (b + r * f)[:-1]
    return a


def residual(x: np.ndarray, fs: float, size: int, hop: int) -> np.ndarray:
    """What a predictor of each Blackman-windowed frame leaves of its first hop samples; zero for silent frames and after the last.

    The order is fs / 1000 + 4. The first frames, which have no samples of that many before them, see zeros there; the first
    ``order`` samples are faded in.
    """
    order = int(fs / 1000) + 4
    out = np.zeros(len(x))
    for k, fr in enumerate(frames(x, size, hop)):
        at = k * hop
        if np.abs(fr).sum() < 1e-5:
            continue
        before = x[at - order : at] if at > order else np.zeros(order)
        a = burg(fr * np.blackman(size), order)
        left = np.convolve(np.concatenate([before, fr]), a)[order : order + min(hop, size)]
        out[at : at + len(left)] = left
    fade = np.hamming(2 * order)[:order][: len(out)]
    out[: len(fade)] *= fade
    return out


def sharpened(h: np.ndarray, fs: float) -> np.ndarray:
    """h * h over its mean in [i - p, i + p), p: 2 ms; at the end in [i, end)."""
    p = int(fs * 2 / 1000)
    total, i, n = np.concatenate([[0.0], np.cumsum(h)]), np.arange(len(h)), len(h)
    a = np.where(i >= n - p, i, np.maximum(i - p, 0))
    b = np.maximum(np.minimum(i + p, n), a + 1)
    return h * h / ((total[b] - total[a]) / (b - a) + TINY)


def residual_envelope(x: np.ndarray, fs: float, size: int, hop: int) -> np.ndarray:
    """The residual's Hilbert envelope, sharpened, over 1.05 of its peak."""
    e = sharpened(np.abs(analytic(residual(x, fs, size, hop))), fs)
    return e / (1.05 * e.max() + TINY)


def strengths(z: np.ndarray) -> np.ndarray:
    """At upward zero crossings of z (the sample before them) the step across, over the largest; 0 elsewhere."""
    out = np.zeros(len(z))
    at = np.flatnonzero((z[:-1] <= 0) & (z[1:] > 0))
    at = at[at > 0]
    out[at] = np.abs(z[at + 1] - z[at - 1])
    return out / (out.max() + TINY) if len(out) else out


def sidelobe_ratio(x: np.ndarray, fs: float, size: int, hop: int, near: int = 12, lobe: int = 30) -> np.ndarray:
    """At each sample the ratio of the next epoch's peak in the residual's envelope to the variance round it, over the largest.

    An epoch's peak is sought ``near`` samples to both sides; epochs whose lobes reach over an end have ratio 0. After the last peak
    its ratio stays. Without epochs there are zeros.
    """
    e = residual_envelope(x, fs, size, hop)
    s = strengths(zero_frequency_wave(x, fs, size, hop))
    epochs = np.flatnonzero(s / (1.05 * s.max() + TINY) > 0.01) if len(s) else np.zeros(0, int)
    place, ratio = [], []
    for at in epochs:
        v = e[max(at - near, 0) : at + near]
        found = peaks(v)
        peak = int(found[v[found].argmax()]) if len(found) else 0
        centre = max(int(at - near - 1 + peak), 0)
        a, b = centre - 1 - lobe, centre + 1 + lobe
        spread = e[a:b].var() if 0 < a and b <= len(e) else None
        place.append(centre)
        ratio.append(0.0 if spread is None else v[peak] if spread == 0 else v[peak] / (spread + TINY))
    if not place:
        return np.zeros(len(x))
    place, ratio = np.maximum.accumulate(place), np.array(ratio) / (max(ratio) + TINY)
    return ratio[np.minimum(np.searchsorted(place, np.arange(len(x))), len(place) - 1)]


def low_pass(taps: int, cutoff: float) -> np.ndarray:
    """Windowed sinc of ``taps`` taps, cutoff as a part of half the rate, of gain 1 at 0."""
    k = np.arange(taps) - (taps - 1) / 2
    b = cutoff * np.sinc(cutoff * k) * np.hamming(taps)
    return b / b.sum()


def band_filter(low: float, high: float, fs: float, taps: int = 1000) -> np.ndarray:
    """Frequency-sampled filter whose gain rises from ``low`` to 1 at ``high`` and falls to 0 one hundredth above."""
    half = fs / 2 + TINY
    f = np.array([0, low / half, high / half, 1.01 * high / half, 1])
    if f[3] > 1:
        f[2:4] = 0.99, 0.999
    grid = np.linspace(0, 1, 1 + (1 << (taps - 1).bit_length()))
    gain = np.interp(grid, f, [0, 0, 1, 0, 0])
    wave = np.fft.irfft(gain * np.exp(-0.5j * np.pi * (taps - 1) * grid))[:taps]
    return wave * np.hamming(taps)


def filtered(x: np.ndarray, b: np.ndarray, skip: int, until: int) -> np.ndarray:
    """Samples skip .. len - until of the full convolution, by FFT."""
    n = len(x) + len(b) - 1
    y = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(b, n), n)
    return y[skip : n - until]


def modulation_spectrum(x: np.ndarray, fs: float, window: int, step: int, bands: int = 18, cutoff: float = 28.0, order: int = 1000, every: int = 100) -> np.ndarray:
    """4 Hz power of the bands' envelopes in windows of the decimated envelope, summed, over the largest.

    Bands are even in mel (2595 log10) up to fs / 2, each from a fifth below its lower edge, the first from 0.1 Hz. Windows start at
    1, 1 + step, ... of the decimated envelope, the last one at its end; too few values give no windows.
    """
    edge = 700 * (10 ** (np.linspace(0, np.log10(1 + fs / 2 / 700), bands + 1)) - 1)
    smooth, thin = low_pass(200, cutoff / (fs / 2)), low_pass(20 * every + 1, 1 / every)
    total = None
    for k in range(bands):
        y = filtered(x, band_filter(0.8 * edge[k] if k else 0.1, edge[k + 1], fs, order), order // 2, order // 2)
        y = filtered(np.maximum(y, 0), smooth, 100, 100)
        y = filtered(y, thin, 10 * every, 10 * every)[::every]
        y = y / (y.mean() + TINY)
        many = (len(y) - window + step) // step
        if many < 1:
            return np.zeros(0)
        first = np.minimum(1 + step * np.arange(many), len(y) - window)
        s = np.fft.fft(y[first[:, None] + np.arange(window)] * np.hamming(window), 80)[:, 5]
        total = np.abs(s) ** 2 + (0 if total is None else total)
    return total / (total.max() + TINY)


def modulation_wave(x: np.ndarray, fs: float, size: int, hop: int, every: int = 100) -> np.ndarray:
    """modulation_spectrum (window and step: size and hop in ms) by sample: values repeated, its least value before and after.

    Waves too short for it give zeros.
    """
    window, step = max(1, round(1000 * size / fs)), max(1, round(1000 * hop / fs))
    m = modulation_spectrum(x, fs, window, step, every=every) if len(x) > 2 * every else np.zeros(0)
    if not len(m):
        return np.zeros(len(x))
    y = np.repeat(m, every * step)
    left = max(len(x) - len(y), 0) // 2
    return np.pad(y, (left, max(len(x) - len(y) - left, 0)), constant_values=m.min())[: len(x)]


def bursts_suppressed(m: np.ndarray, window: int = 20, part: float = 0.3) -> np.ndarray:
    """Marks whose window holds few of them are cleared, each seeing what was cleared before it."""
    m, h = m.copy(), window // 2
    least = int(np.ceil(window * part))
    for i in range(window, len(m) - window):
        if m[i - h : i + h].sum() <= least:
            m[i] = 0
    return m


def mixed(x: np.ndarray, noise: np.ndarray, db: float) -> np.ndarray:
    """x with noise, repeated to its length, at a signal-to-noise ratio; without mean and scaled to its peak."""
    z = np.resize(noise, len(x))
    gain = np.sqrt((x**2).mean() / 10 ** (db / 10) / max((z**2).mean(), 1e-12))
    y = x + gain * z
    y = y - y.mean()
    return y / (np.abs(y).max() + 1e-7)


def resampled(x: np.ndarray, fs: int, to: int) -> np.ndarray:
    """x at another rate, by cutting or padding its spectrum."""
    n = int(round(len(x) * to / fs))
    if n == len(x) or not len(x):
        return x
    return np.fft.irfft(np.fft.rfft(x)[: n // 2 + 1], n) * n / len(x)
