"""Parameters of the whole analysis, and the YAML files that hold them."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from somaflow.operators.motion import MotionParams


@dataclass(frozen=True)
class PatchParams:
    """How the image is divided for initialisation."""

    nb_patch: tuple[int, int] = (3, 4)
    overlaps: int = 40


@dataclass(frozen=True)
class NoiseParams:
    noise_method: str = "mean"
    noise_range: tuple[float, float] = (0.25, 0.5)
    max_num_samples_fft: int = 3072
    check_nan: bool = False


@dataclass(frozen=True)
class InitParams:
    """Seeds: expected half size and box half width of neurons, and what a seed has to reach."""

    gSig: tuple[int, int] = (4, 4)
    gSiz: tuple[int, int] = (10, 10)
    ssub: int = 2
    tsub: int = 2
    thresh_init: float = 2
    min_corr: float = 0.8
    min_pnr: float = 10
    bd: int = 1
    min_pixel: int = 3
    center_psf: bool = True
    filter_data_centering: bool = True
    ring_size_factor: float = 1.5
    max_neurons: int | None = None


@dataclass(frozen=True)
class TemporalParams:
    p: int = 1
    method: str = "oasis"
    ITER: int = 2
    bas_nonneg: bool = False
    fudge_factor: float = 0.96
    lags: int = 5
    nb: int = 16
    noise_method: str = "mean"


@dataclass(frozen=True)
class SpatialParams:
    method: str = "dilate"
    method_least_square: str = "lasso_lars"
    normalize: bool = True
    thr_method: str = "nrg"
    maxthr: float = 0.1
    nrgthr: float = 0.9999
    extract_cc: bool = True


@dataclass(frozen=True)
class MergeParams:
    """``compat``: the bound applies to the sum of both entries of the symmetric correlation, i.e. to twice r."""

    thr: float = 0.8
    compat: bool = True


@dataclass(frozen=True)
class ExtractionParams:
    patch_params: PatchParams = field(default_factory=PatchParams)
    preprocess_params: NoiseParams = field(default_factory=NoiseParams)
    init_params: InitParams = field(default_factory=InitParams)
    temporal_params: TemporalParams = field(default_factory=TemporalParams)
    spatial_params: SpatialParams = field(default_factory=SpatialParams)
    merge_params: MergeParams = field(default_factory=MergeParams)
    seed: int = 0


@dataclass(frozen=True)
class Parameters:
    frame_rate: float = 30
    motion_correction: MotionParams = field(default_factory=MotionParams)
    cnmfe: ExtractionParams = field(default_factory=ExtractionParams)


def default_parameters(key: str = "all"):
    """The defaults of everything, of ``cnmfe`` or of ``motion_correction``."""
    p = Parameters()
    if key == "all":
        return p
    if key in ("cnmfe", "motion_correction"):
        return getattr(p, key)
    raise KeyError(key)


def merged(base, values: dict):
    """A dataclass with the values of a nested mapping; keys that nothing here reads are left out."""
    known = {f.name for f in fields(base)}
    out = {}
    for k, v in values.items():
        if k in known:
            old = getattr(base, k)
            out[k] = merged(old, v) if isinstance(v, dict) else tuple(v) if isinstance(old, tuple) else v
    return replace(base, **out)


def load(path: str) -> Parameters:
    """Parameters of a YAML file, whose tuples and lists may be tagged as Python's; no other tag is accepted."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("tag:yaml.org,2002:python/tuple", lambda loader, node: tuple(loader.construct_sequence(node, deep=True)))
    Loader.add_constructor("tag:yaml.org,2002:python/list", lambda loader, node: loader.construct_sequence(node, deep=True))
    with open(path) as f:
        return merged(Parameters(), yaml.load(f, Loader) or {})
