"""The frozen percentile table: 101 composites at the percentiles 0 to 100 of a reference corpus."""

from __future__ import annotations

from itertools import accumulate

#: The first knot and the steps to the next ones, in ten-thousandths.
_STEPS = """
666235 74331 16931 5608 2901 2447 1291 1910 2185 2473 3495 4053 2945 2181 1797 1310 828 1129 910 1012 1312
1086 1192 1498 1011 1758 1388 1162 918 1089 1494 1416 1325 1554 1895 1822 1662 2367 2070 2193 2040 2910 3225
1934 1283 2663 2480 3071 1712 2262 3089 2664 2115 2762 1684 1880 2171 2918 2694 2403 2806 2287 2286 2470 2495
1868 1664 1869 1782 1655 1705 1889 2167 1802 2196 2019 2238 1894 2447 2168 2641 2947 1815 2252 3036 2450 2752
2243 2152 2187 2952 3691 3974 2652 3017 3312 4047 3639 4582 5808 22000
"""

KNOTS: tuple[float, ...] = tuple(x / 10_000 for x in accumulate(map(int, _STEPS.split())))
