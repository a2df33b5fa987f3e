"""Operators by name: what each name stands for here.

``find(name)`` gives the callable. Scalar functions take and give Columns; the rest take Series.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np

from tidemark.functions import geo, shapes, udfs
from tidemark.functions.scalars import SCALARS
from tidemark.operators import frameworks as fw
from tidemark.operators import hooks, mappers, meta, motion, patterns, stats
from tidemark.operators import series as ops
from tidemark.operators.aggregates import BUILDERS
from tidemark.sources import ingest, selector

OPERATORS: dict[str, Callable] = {}

_NULL_RULES = {"sum": ("forbid-nulls", "nonnull"), "min": ("forbid-nulls", "nonnull"), "max": ("forbid-nulls", "nonnull"), "join": ("forbid-nulls", "nonnull", "urlencoded"), "mean": ("exclude-nulls",), "median": ("forbid-nulls",), "percentile": ("forbid-nulls",), "and": ("exclude-nulls",), "or": ("exclude-nulls",), "count": ("include-nulls", "exclude-nulls", "nonnull"), "mean.circular": ("exclude-nulls",), "rms": ("exclude-nulls",), "var": ("forbid-nulls",), "sd": ("forbid-nulls",), "var.welford": ("forbid-nulls",), "sd.welford": ("forbid-nulls",)}
for _name in BUILDERS:
    OPERATORS[f"bucketizer.{_name}"] = partial(fw.bucketize, name=_name)
    OPERATORS[f"mapper.{_name}"] = partial(fw.window_map, name=_name)
    OPERATORS[f"reducer.{_name}"] = partial(fw.reduce_series, name=_name)
    for _rule in _NULL_RULES.get(_name, ()):
        OPERATORS[f"reducer.{_name}.{_rule}"] = partial(fw.reduce_series, name=f"{_name}.{_rule}")
for _name in ("argmin", "argmax"):
    OPERATORS[f"reducer.{_name}"] = partial(fw.reduce_series, name=_name)
for _name in fw.KERNELS:
    OPERATORS[f"mapper.kernel.{_name}"] = partial(fw.kernel, name=_name)
for _name in mappers.MAPPERS:
    OPERATORS[_name] = partial(mappers.map_points, name=_name)
for _name in ("add", "sub", "mul", "div", "mask", "negmask", "eq", "ne", "lt", "gt", "le", "ge", "and", "or", "add.ignore-nulls", "mul.ignore-nulls", "and.ignore-nulls", "or.ignore-nulls"):
    OPERATORS[f"op.{_name}"] = partial(fw.apply_op, op=f"op.{_name}")
for _name in ("byclass", "bylabels", "byattr", "bylabelsattr", "bymetadata", "byselector", "bysize", *(f"{k}.{o}" for k in ("last", "any", "all") for o in ("eq", "ne", "lt", "gt", "le", "ge"))):
    OPERATORS[f"filter.{_name}"] = partial(fw.filter_series, name=f"filter.{_name}")
for _name in ("value", "next", "previous", "interpolate", "linear"):
    OPERATORS[f"filler.{_name}"] = partial(fw.fill, how=_name)
for _name, _f in (("spline", hooks.spline), ("akima", hooks.akima), ("newton", hooks.newton)):
    OPERATORS[f"filler.{_name}"] = partial(hooks.filler, f=hooks.by_curve(_f))
OPERATORS["filler.lowess"] = hooks.lowess_filler
OPERATORS["filler.rlowess"] = partial(hooks.lowess_filler, rounds=2)
OPERATORS["filler.trend"] = partial(hooks.filler, f=hooks.trend, pre=2, post=2)

OPERATORS |= SCALARS
OPERATORS |= udfs.UDFS
OPERATORS |= {
    "BUCKETIZE": fw.bucketize,
    "BUCKETIZE.CALENDAR": fw.bucketize_calendar,
    "UNBUCKETIZE": fw.unbucketize,
    "UNBUCKETIZE.CALENDAR": fw.unbucketize_calendar,
    "MAP": fw.window_map,
    "REDUCE": fw.reduce_series,
    "PREDUCE": fw.reduce_series,
    "APPLY": fw.apply_op,
    "PAPPLY": fw.apply_op,
    "FILTER": fw.filter_series,
    "PFILTER": fw.filter_series,
    "FILL": fw.cross_fill,
    "FILLPREVIOUS": partial(fw.fill, how="previous"),
    "FILLNEXT": partial(fw.fill, how="next"),
    "FILLVALUE": partial(fw.fill, how="value"),
    "FILLTICKS": fw.fill_ticks,
    "INTERPOLATE": partial(fw.fill, how="interpolate"),
    "CROP": fw.crop,
    "PARTITION": fw.partition,
    "STRICTPARTITION": fw.strict_partition,
    "PIVOT": fw.pivot,
    "PIVOTSTRICT": partial(fw.pivot, all_needed=True),
    "COMMONTICKS": fw.common_ticks,
    "STRICTMAPPER": fw.strict,
    "STRICTREDUCER": lambda s, by, name, **p: fw.reduce_series(s, by, f"{name}.forbid-nulls", **p),
    "MACROMAPPER": hooks.mapper,
    "MACROREDUCER": hooks.reducer,
    "MACROBUCKETIZER": hooks.bucketizer,
    "MACROFILTER": hooks.series_filter,
    "MACROFILLER": hooks.filler,
    "filter.latencies": fw.latencies,
    "mapper.dotproduct": partial(fw.window_map, name="dotproduct"),
    "mapper.geo.approximate": mappers.geo_approximate,
    "mapper.geo.clear": mappers.geo_clear,
    "mapper.hdist": geo.distance,
    "mapper.hspeed": geo.speed,
    "mapper.truecourse": geo.course,
    "DEDUP": ops.dedup,
    "VALUEDEDUP": ops.value_dedup,
    "COMPACT": ops.compact,
    "RANGECOMPACT": ops.range_compact,
    "SHRINK": ops.shrink,
    "ONLYBUCKETS": ops.only_buckets,
    "REMOVETICK": ops.remove_tick,
    "TIMECLIP": ops.time_clip,
    "CLIP": ops.clip,
    "TIMESHIFT": ops.time_shift,
    "TIMESCALE": ops.time_scale,
    "TIMEMODULO": ops.time_modulo,
    "TICKINDEX": ops.tick_index,
    "RESETS": ops.resets,
    "MONOTONIC": ops.monotonic,
    "INTEGRATE": ops.integrate,
    "STANDARDIZE": ops.standardize,
    "NORMALIZE": ops.normalize,
    "ISONORMALIZE": ops.iso_normalize,
    "ZSCORE": ops.zscore,
    "QUANTIZE": ops.quantize,
    "TIMESPLIT": ops.time_split,
    "CHUNK": ops.chunk,
    "VALUESPLIT": ops.value_split,
    "MERGE": ops.merge,
    "FUSE": ops.fuse,
    "RELABEL": ops.relabel,
    "RENAME": ops.rename,
    "FIRSTTICK": ops.first_tick,
    "LASTTICK": ops.last_tick,
    "ATINDEX": ops.at_index,
    "ATTICK": ops.at_tick,
    "ATBUCKET": ops.at_bucket,
    "LASTSORT": ops.last_sort,
    "NONEMPTY": ops.nonempty,
    "EMPTY": ops.empty,
    "COPYGEO": ops.copy_place,
    "TICKS": ops.lists,
    "VALUES": ops.lists,
    "LOCATIONS": ops.lists,
    "ELEVATIONS": ops.lists,
    "MUSIGMA": stats.mu_sigma,
    "NSUMSUMSQ": stats.n_sum_sumsq,
    "KURTOSIS": stats.kurtosis,
    "SKEWNESS": stats.skewness,
    "VALUEHISTOGRAM": stats.histogram,
    "MODE": stats.mode,
    "PROB": stats.prob,
    "CPROB": stats.cprob,
    "LR": stats.linear_regression,
    "CORRELATE": stats.correlate,
    "NBOUNDS": stats.nbounds,
    "LBOUNDS": stats.lbounds,
    "THRESHOLDTEST": stats.threshold_test,
    "ZSCORETEST": stats.zscore_test,
    "GRUBBSTEST": stats.grubbs_test,
    "ESDTEST": stats.esd_test,
    "STLESDTEST": stats.stl_esd_test,
    "SINGLEEXPONENTIALSMOOTHING": stats.single_exponential,
    "DOUBLEEXPONENTIALSMOOTHING": stats.double_exponential,
    "LOWESS": stats.lowess,
    "RLOWESS": partial(stats.lowess, rounds=2),
    "STL": stats.stl,
    "LTTB": stats.lttb,
    "TLTTB": partial(stats.lttb, by_time=True),
    "LOWERHULL": stats.hull,
    "UPPERHULL": partial(stats.hull, upper=True),
    "FFT": stats.fft,
    "FFTAP": partial(stats.fft, polar=True),
    "IFFT": stats.ifft,
    "FDWT": motion.wavelet,
    "IDWT": partial(motion.wavelet, inverse=True),
    "DTW": partial(stats.dtw_distance, scale="range"),
    "ZDTW": partial(stats.dtw_distance, scale="z"),
    "RAWDTW": stats.dtw_distance,
    "PATTERNS": patterns.patterns,
    "ZPATTERNS": partial(patterns.patterns, standardise=True),
    "PATTERNDETECTION": patterns.detect,
    "ZPATTERNDETECTION": partial(patterns.detect, standardise=True),
    "DISCORDS": patterns.discords,
    "ZDISCORDS": partial(patterns.discords, z=True),
    "OPTDTW": motion.best_dtw,
    "FFTWINDOW": motion.fft_window,
    "LOCATIONOFFSET": motion.location_offset,
    "MOTIONSPLIT": motion.motion_split,
    "POLYFIT": stats.polyfit,
    "POLYFUNC": stats.polynomial,
    "RANDPDF": stats.random_from,
    "SRANDPDF": lambda histogram, seed: stats.random_from(histogram, seed),
    "HAVERSINE": geo.haversine,
    "->HHCODELONG": geo.hhcode,
    "->GEOHASH": geo.geohash,
    "BBOX": geo.bbox,
    "GEO.WITHIN": geo.all_within,
    "GEO.INTERSECTS": geo.all_within,
    "GEO.WKT": shapes.from_wkt,
    "GEO.WKB": shapes.from_wkb,
    "GEO.JSON": shapes.from_geojson,
    "GEO.GML": shapes.from_gml,
    "GEO.KML": shapes.from_kml,
    "->WKT": shapes.to_wkt,
    "->WKB": shapes.to_wkb,
    "->GEOJSON": shapes.to_geojson,
    "->GML": shapes.to_gml,
    "->KML": shapes.to_kml,
    "->GEOSHAPE": shapes.cover,
    "GEO.NORMALIZE": shapes.normal,
    "GEO.UNION": shapes.union,
    "GEO.INTERSECTION": shapes.intersection,
    "GEO.DIFFERENCE": shapes.difference,
    "GEO.REGEXP": shapes.regexp,
    "HHCODE.BBOX": shapes.cell_box,
    "HHCODE.CENTER": shapes.cell_center,
    "->GEOCELL": shapes.to_geocell,
    "GEOCELL->": shapes.from_geocell,
    **{f"HHCODE.{n}": partial(shapes.neighbour, north=a, east=b) for n, a, b in (("NORTH", 1, 0), ("SOUTH", -1, 0), ("EAST", 0, 1), ("WEST", 0, -1), ("NORTH.EAST", 1, 1), ("NORTH.WEST", 1, -1), ("SOUTH.EAST", -1, 1), ("SOUTH.WEST", -1, -1))},
    "FIND": meta.find,
    "FINDSETS": meta.find_sets,
    "FINDSTATS": meta.find_stats,
    "METASET": meta.meta_set,
    "META": meta.meta,
    "METADIFF": partial(meta.meta, diff=True),
    **{f"FETCH{k}": partial(meta.fetch_type, kind=k) for k in ("LONG", "DOUBLE", "STRING", "BOOLEAN")},
    "ZIP": meta.zipped,
    "SORT": meta.sort,
    "RSORT": partial(meta.sort, reverse=True),
    "VALUESORT": meta.value_sort,
    "RVALUESORT": partial(meta.value_sort, reverse=True),
    "METASORT": meta.meta_sort,
    "MAKEGTS": meta.make,
    "ADDVALUE": meta.add_value,
    "SETVALUE": partial(meta.add_value, overwrite=True),
    "CLONEEMPTY": meta.clone_empty,
    "SETATTRIBUTES": meta.set_attributes,
    "BUCKETSPAN": meta.bucket_span,
    "BUCKETCOUNT": meta.bucket_count,
    "LASTBUCKET": meta.last_bucket,
    "NAME": meta.name,
    "LABELS": meta.labels,
    "ATTRIBUTES": meta.attributes,
    "LASTACTIVITY": meta.last_activity,
    "LOCSTRINGS": meta.loc_strings,
    "TICKLIST": meta.tick_list,
    "MVVALUES": meta.multi("value"),
    "MVTICKS": meta.multi("tick"),
    "MVELEVATIONS": meta.multi("elev"),
    "MVLOCATIONS": meta.multi("location"),
    "MVHHCODES": meta.multi("hhcode"),
    "MVTICKSPLIT": meta.multi_split,
    "MVINDEXSPLIT": partial(meta.multi_split, by_index=True),
    "PROBABILITY": meta.probability,
    "mapper.dotproduct.tanh": partial(fw.window_map, name="dotproduct.tanh"),
    "mapper.dotproduct.sigmoid": partial(fw.window_map, name="dotproduct.sigmoid"),
    "mapper.dotproduct.positive": partial(fw.window_map, name="dotproduct.positive"),
    "HHCODE->": geo.from_hhcode,
    "GTSHHCODE->": geo.from_hhcode,
    "->HHCODE": geo.hhcode_text,
    "GEOHASH->": geo.from_geohash,
    "INTERPOLATOR.1D.LINEAR": np.interp,
    "INTERPOLATOR.1D.SPLINE": hooks.spline,
    "INTERPOLATOR.1D.AKIMA": hooks.akima,
    "PARSESELECTOR": selector.parse,
    "TOSELECTOR": selector.render,
    "FETCH": selector.fetch,
    "METAMATCH": selector.predicate,
    "PARSE": ingest.parse_lines,
    "PARSEVALUE": ingest.value_type,
    "ILP->": ingest.parse_influx,
    "UPDATE": ingest.append,
    "DELETE": ingest.without,
}


def find(name: str) -> Callable:
    if name not in OPERATORS:
        raise KeyError(f"no operator named {name!r}")
    return OPERATORS[name]
