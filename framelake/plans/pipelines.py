"""Whole pipelines: registration, compression, filtering, seeding and demixing, each with its configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators import graph, pixel
from framelake.plans import demix, movies, strategies
from framelake.sources.movie import Movie


@dataclass(frozen=True)
class SeedConfig:
    """MAD factor of the traces, least correlation of a seed, its distance, patch and residual threshold."""

    mad: float = 1.0
    cutoff: float = 0.5
    distance: int = 1
    patch: int = 100
    threshold: float = 0.3


@dataclass(frozen=True)
class PipelineConfig:
    registration: object = field(default_factory=strategies.Rigid)
    template_passes: int = 3
    compression: object = field(default_factory=strategies.Compress)
    highpass_sigma: float | None = None
    trace_cutoff: float | None = None
    rate: float = 30.0
    #: One pass of seeds and demixing for each pair.
    passes: tuple[tuple[SeedConfig, demix.DemixConfig], ...] = ((SeedConfig(), demix.DemixConfig()),)


@dataclass(frozen=True)
class PipelineResults:
    registered: DataFrame
    compressed: strategies.Compressed
    demixed: demix.DemixResults | None


def register(movie: Movie, config: PipelineConfig) -> DataFrame:
    """Corrected frames with their shifts; the template is fitted if the strategy has none."""
    how = config.registration
    if isinstance(how, strategies.Gradient):
        how = how if how.template is not None else how.fitted(movie.frames)
    elif not isinstance(how, strategies.Identity) and how.template is None:
        how = how.fitted(movie.frames, passes=config.template_passes)
    return graph.checkpointed(how.correct(movie.frames))


def compress(registered: DataFrame, shape: tuple[int, int, int], config: PipelineConfig) -> strategies.Compressed:
    n, h, w = shape
    made = config.compression.compress(Movie(registered, shape).long(), h, w, n)
    if config.highpass_sigma:
        u, v, image = movies.spatially_filtered(made.u, made.v, made.image, h, w, config.highpass_sigma)
        made = strategies.Compressed(u, graph.checkpointed(v), graph.checkpointed(image), h, w)
    if config.trace_cutoff:
        rows = made.v.groupBy("comp").agg(F.array_sort(F.collect_list(F.struct("frame", "value"))).alias("t")).select("comp", F.col("t.frame").alias("frames"), F.col("t.value").alias("trace"))
        sharp = movies.filtered_traces(rows, config.trace_cutoff, config.rate)
        v = sharp.select("comp", F.explode(F.arrays_zip("frames", "trace")).alias("z")).select("comp", F.col("z.frames").alias("frame"), F.col("z.trace").alias("value"))
        made = strategies.Compressed(made.u, graph.checkpointed(v), made.image, h, w)
    return made


def correlation_image(made: strategies.Compressed, mad: float) -> DataFrame:
    """Neighbour correlations of the factored movie's thresholded traces (y, x, corr)."""
    flat = made.movie(rescale=False).select("frame", F.expr(f"CAST(pixel div {made.width} AS INT)").alias("y"), F.expr(f"CAST(pixel % {made.width} AS INT)").alias("x"), F.col("value").alias("v"))
    return graph.checkpointed(pixel.neighbour_correlation(pixel.mad_kept(graph.checkpointed(flat), mad)))


def demixed(made: strategies.Compressed, config: PipelineConfig) -> demix.DemixResults | None:
    """Passes of seeding and demixing, each adding to the signals found before; None without any seed."""
    out, shape = None, (made.height, made.width)
    for s, d in config.passes:
        image = correlation_image(made, s.mad)
        a, c = demix.seeds(made.u, made.v, image, *shape, s.cutoff, s.distance, s.patch, s.threshold, out.a if out else None, out.c if out else None)
        if a.isEmpty():
            return out
        out = demix.demix(made.u, made.v, a, c, d, shape)
    return out


def run(movie: Movie, config: PipelineConfig = PipelineConfig()) -> PipelineResults:
    """Two-photon or voltage imaging: all of it."""
    registered = register(movie, config)
    made = compress(registered, movie.shape, config)
    return PipelineResults(registered, made, demixed(made, config))


def run_widefield(movie: Movie, config: PipelineConfig = PipelineConfig()) -> PipelineResults:
    """Registration and compression only."""
    registered = register(movie, config)
    return PipelineResults(registered, compress(registered, movie.shape, config), None)


def demix_footprints(made: strategies.Compressed, a: DataFrame, config: demix.DemixConfig = demix.DemixConfig()) -> demix.DemixResults:
    """Demixing from given footprints (pixel, comp, value)."""
    return demix.demix(made.u, made.v, *demix.custom_seeds(made.u, made.v, a), config, (made.height, made.width))
