"""Tensor operations as column expressions over array<double>: narrow, no shuffle, no Python.

An image plane of height h and width w is an array of h * w numbers, row by row; several channels stand one behind the
other. Shapes are parameters, because they belong to the plan and not to the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the error function's polynomial (Abramowitz and Stegun 7.1.26).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
LAYER_NORM_EPSILON, BATCH_NORM_EPSILON = 1e-6, 1e-5


def num(x: float) -> Column:
    return F.lit(float(x))


# scalars


def relu(x: Column) -> Column:
    """max(x, 0), with 0 for NaN."""
    return F.when(x > 0, F.nanvl(x, num(0))).otherwise(num(0))


def erf(x: Column) -> Column:
    t = 1 / (1 + num(ERF_P) * F.abs(x))
    poly = num(ERF_A[4])
    for a in reversed(ERF_A[:4]):
        poly = poly * t + num(a)
    return F.signum(x) * (1 - poly * t * F.exp(-x * x))


def gelu(x: Column) -> Column:
    return num(0.5) * x * (1 + erf(x * num(0.7071067811865476)))


def hard_sigmoid(x: Column, alpha: float = 1 / 6, beta: float = 0.5) -> Column:
    return F.least(F.greatest(num(alpha) * x + num(beta), num(0)), num(1))


def hard_swish(x: Column) -> Column:
    return x * hard_sigmoid(x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def affine(x: Column, scale: float, bias: float) -> Column:
    return x * num(scale) + num(bias)


# arrays


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once per row: inside a lambda an expression is evaluated for each element anew."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def each(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(a, f)


def total(a: Column) -> Column:
    return F.aggregate(a, num(0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def broadcasted(a: Column, b: Column, op: Callable[[Column, Column], Column]) -> Column:
    """op over two arrays; a shorter b is repeated over a, as trailing dimensions broadcast."""
    return let(b, lambda y: F.transform(a, lambda x, i: op(x, F.element_at(y, (i % F.size(y)) + 1))))


def softmax(a: Column) -> Column:
    """Less the maximum, then times the reciprocal of the sum of exponentials."""
    powers = let(a, lambda v: let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m))))
    return let(powers, lambda p: let(1 / total(p), lambda inverse: F.transform(p, lambda x: x * inverse)))


def rows_of(a: Column, n: int, width: int) -> list[Column]:
    return [F.slice(a, k * width + 1, width) for k in range(n)]


def by_row(a: Column, width: int, f: Callable[[Column], Column]) -> Column:
    """f over each row of width numbers."""
    return let(a, lambda x: F.flatten(F.transform(upto((F.size(x) / width).cast("int")), lambda k: f(F.slice(x, k * width + 1, F.lit(width))))))


def bias_softmax(a: Column, bias: Column) -> Column:
    return softmax(F.zip_with(a, bias, lambda x, y: x + y))


def layer_norm(a: Column, gamma: Column | None = None, beta: Column | None = None, epsilon: float = LAYER_NORM_EPSILON) -> Column:
    """Biased variance over the whole array."""
    centred = let(a, lambda v: let(mean(v), lambda m: F.transform(v, lambda x: x - m)))
    out = let(centred, lambda d: let(F.sqrt(mean(F.transform(d, lambda x: x * x)) + num(epsilon)), lambda spread: F.transform(d, lambda x: x / spread)))
    if gamma is not None:
        out = F.zip_with(out, gamma, lambda x, g: x * g)
    return out if beta is None else F.zip_with(out, beta, lambda x, b: x + b)


def batch_norm(x: Column, mean_: float, variance: float, gamma: float, beta: float, epsilon: float = BATCH_NORM_EPSILON) -> Column:
    scale = gamma / (variance + epsilon) ** 0.5
    return x * num(scale) + num(beta - mean_ * scale)


def folded_batch_norm(weights: Sequence[float], bias: float, mean_: float, variance: float, gamma: float, beta: float, epsilon: float = BATCH_NORM_EPSILON) -> tuple[list[float], float]:
    """Weights and bias of a convolution that has the normalisation behind it within."""
    scale = gamma / (variance + epsilon) ** 0.5
    return [w * scale for w in weights], (bias - mean_) * scale + beta


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), num(0), lambda s, x: s + x)


def upto(n: int | Column) -> Column:
    """0, 1, ... n - 1."""
    return F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1)


def matmul(a: Column, b: Column, rows: int, inner: int, cols: int) -> Column:
    """(rows, inner) times (inner, cols): a plan of one size for any shape, the cells are counted in the data."""

    def cells(x: Column, y: Column) -> Column:
        def cell(i: Column) -> Column:
            r, c = F.floor(i / cols).cast("int"), i % cols
            return F.aggregate(upto(inner), num(0), lambda s, k: s + F.get(x, r * inner + k) * F.get(y, k * cols + c))

        return F.transform(upto(rows * cols), cell)

    return let(a, lambda x: let(b, lambda y: cells(x, y)))


def permute(a: Column, shape: Sequence[int], axes: Sequence[int]) -> Column:
    """A tensor of this shape with its axes in another order; axis k of the result is axis axes[k] of a."""
    if sorted(axes) != list(range(len(shape))):
        raise ValueError("axes must name each axis once")
    strides = [1] * len(shape)
    for k in range(len(shape) - 2, -1, -1):
        strides[k] = strides[k + 1] * shape[k + 1]
    size = strides[0] * shape[0] if shape else 1

    def source(i: Column) -> Column:
        place, inner = F.lit(0), size
        for axis in axes:
            inner //= shape[axis]
            place = place + F.floor(i / inner).cast("int") % shape[axis] * strides[axis]
        return place

    return let(a, lambda x: F.transform(upto(size), lambda i: F.get(x, source(i))))


def transpose(a: Column, rows: int, cols: int) -> Column:
    return permute(a, (rows, cols), (1, 0))


def matmul_bias_softmax(a: Column, b: Column, bias: Column, rows: int, inner: int, cols: int) -> Column:
    """softmax(a b + bias) of each row."""
    return by_row(matmul(a, b, rows, inner, cols), cols, lambda r: bias_softmax(r, bias))


def linear(a: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """x W^T + b with W of shape (out, in)."""
    return F.array(*[dot(a, F.array(*map(num, w))) + num(b) for w, b in zip(weights, bias, strict=True)])


def attention(q: Column, k: Column, v: Column, tokens: int, width: int, heads: int = 1) -> Column:
    """softmax(q k^T / sqrt(width)) v of each head; rows are tokens, and the heads stand side by side in a row."""
    scale, row = width**-0.5, heads * width

    def of(q: Column, k: Column, v: Column) -> Column:
        def one(th: Column) -> Column:
            t, head = F.floor(th / heads).cast("int"), th % heads * width
            score = lambda s: F.aggregate(upto(width), num(0), lambda acc, w: acc + F.get(q, t * row + head + w) * F.get(k, s * row + head + w)) * num(scale)
            return let(softmax(F.transform(upto(tokens), score)), lambda p: F.transform(upto(width), lambda w: F.aggregate(upto(tokens), num(0), lambda acc, s: acc + F.get(p, s) * F.get(v, s * row + head + w))))

        return F.flatten(F.transform(upto(tokens * heads), one))

    return let(q, lambda x: let(k, lambda y: let(v, lambda z: of(x, y, z))))


# planes


def at(a: Column, y: Column, x: Column, h: int, w: int, outside: Column | None = None) -> Column:
    """a[y, x], and outside (0 unless given) beyond the edges."""
    inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
    return F.when(inside, F.get(a, (y * w + x).cast("int"))).otherwise(num(0) if outside is None else outside)


def output_size(size: int, kernel: int, stride: int, before: int, behind: int, ceil: bool = False) -> int:
    room = size + before + behind - kernel
    if room < 0:
        raise ValueError("the padded input is smaller than the kernel")
    return (-(-room // stride) if ceil else room // stride) + 1


def over_grid(h: int, w: int, f: Callable[[Column, Column], Column]) -> Column:
    """The plane of f(y, x)."""
    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: f(F.floor(i / w), i % w))


Kernel = Sequence[Sequence[float]]


def conv2d(planes: Sequence[Column], weights: Sequence[Kernel], bias: float, h: int, w: int, stride: tuple[int, int] = (1, 1), pads: tuple[int, int, int, int] = (0, 0, 0, 0)) -> Column:
    """One output channel: cross-correlation of the input planes with weights[channel][ky][kx]; pads are top, left, bottom, right."""
    return conv2d_layer(F.concat(*planes) if len(planes) > 1 else planes[0], [weights], [bias], h, w, stride, pads)


def conv2d_layer(planes: Column, weights: Sequence[Sequence[Kernel]], bias: Sequence[float], h: int, w: int, stride: tuple[int, int] = (1, 1), pads: tuple[int, int, int, int] = (0, 0, 0, 0), activation: Callable[[Column], Column] | None = None) -> Column:
    """All output channels, one behind the other: weights[output][channel][ky][kx], then bias, then activation (relu, silu, gelu, ...).

    Kernels are a table of taps in the data, and channels and cells are counted there: the plan has one size for any shape.
    """
    top, left, bottom, right = pads
    kh, kw = len(weights[0][0]), len(weights[0][0][0])
    oh, ow = output_size(h, kh, stride[0], top, bottom), output_size(w, kw, stride[1], left, right)

    # the planes are padded once, so that a tap is one place behind that of its cell
    ph, pw = h + top + bottom, w + left + right

    def padded(p: Column) -> Column:
        def cell(i: Column) -> Column:
            y, x = F.floor(i / pw).cast("int") % ph - top, i % pw - left
            return F.when((y >= 0) & (y < h) & (x >= 0) & (x < w), F.get(p, F.floor(i / (ph * pw)).cast("int") * (h * w) + y * w + x)).otherwise(num(0))

        return F.transform(upto(len(weights[0]) * ph * pw), cell)

    def tap(place: int, v: float) -> Column:
        return F.struct(F.lit(place).alias("at"), num(v).alias("w"))

    taps = [F.array(*[tap((c * ph + ky) * pw + kx, v) for c, kernel in enumerate(own) for ky, line in enumerate(kernel) for kx, v in enumerate(line) if v] or [tap(0, 0.0)]) for own in weights]
    kernels = F.array(*[F.struct(own.alias("taps"), num(b).alias("bias")) for own, b in zip(taps, bias, strict=True)])

    def cells(p: Column) -> Column:
        def plane(k: Column) -> Column:
            def cell(place: Column) -> Column:
                out = F.aggregate(k["taps"], k["bias"], lambda acc, x: acc + F.get(p, place + x["at"]) * x["w"])
                # an activation names its argument several times
                return out if activation is None else let(out, activation)

            def line(first: Column) -> Column:
                return F.transform(F.sequence(first, first + (ow - 1) * stride[1], F.lit(stride[1])), cell)

            return F.flatten(F.transform(upto(oh), lambda y: let(y * (stride[0] * pw), line)))

        return F.flatten(F.transform(kernels, plane))

    return let(let(planes, padded) if any(pads) else planes, cells)


def conv_transpose_2x2(plane: Column, weights: Sequence[Sequence[float]], bias: float, h: int, w: int) -> Column:
    """Stride 2: out[2y + ky, 2x + kx] = in[y, x] * weights[ky][kx] + bias."""
    table = F.array(*[num(v) for row in weights for v in row])
    return let(plane, lambda p: over_grid(2 * h, 2 * w, lambda y, x: at(p, F.floor(y / 2), F.floor(x / 2), h, w) * F.get(table, ((y % 2) * 2 + x % 2).cast("int")) + num(bias)))


def pooled(plane: Column, h: int, w: int, kernel: tuple[int, int], stride: tuple[int, int], pads: tuple[int, int, int, int], how: str) -> Column:
    """how: max (NaN ignored) or mean; cells in the padding don't count."""
    top, left, bottom, right = pads
    oh, ow = output_size(h, kernel[0], stride[0], top, bottom), output_size(w, kernel[1], stride[1], left, right)

    def cell(p: Column, y: Column, x: Column) -> Column:
        cells = F.array(*[at(p, y * stride[0] + ky - top, x * stride[1] + kx - left, h, w, F.lit(None).cast("double")) for ky in range(kernel[0]) for kx in range(kernel[1])])
        cells = F.filter(cells, lambda v: v.isNotNull() & ~F.isnan(v) if how == "max" else v.isNotNull())
        return F.array_max(cells) if how == "max" else let(cells, mean)

    return let(plane, lambda p: over_grid(oh, ow, lambda y, x: cell(p, y, x)))


def resize_nearest(plane: Column, h: int, w: int, oh: int, ow: int) -> Column:
    """Source place: the destination's times the input's size, divided by the output's, rounded down."""
    return let(plane, lambda p: over_grid(oh, ow, lambda y, x: at(p, F.floor(y * h / oh), F.floor(x * w / ow), h, w)))


def upsample_add(small: Column, large: Column, h: int, w: int, scale: int) -> Column:
    return F.zip_with(resize_nearest(small, h, w, h * scale, w * scale), large, lambda a, b: a + b)


def squeeze_excite(planes: Column, channels: int, size: int, reduce_: tuple, expand: tuple, alpha: float = 1 / 6) -> Column:
    """Mean of each channel, two small layers (ReLU, hard sigmoid), and each channel times its gate."""
    gate = each(linear(each(linear(F.array(*[mean(x) for x in rows_of(planes, channels, size)]), *reduce_), relu), *expand), lambda x: hard_sigmoid(x, alpha))
    return let(gate, lambda g: F.transform(planes, lambda x, i: x * F.get(g, F.floor(i / size).cast("int"))))


def argmax_last(a: Column) -> Column:
    """Index of the largest number, the last of equal ones."""
    return F.size(a) - F.array_position(F.reverse(a), F.array_max(a)).cast("int")
