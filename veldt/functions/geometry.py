"""Geometry on array and struct cells: rotations, transforms, planes, lines, boxes. All native Columns.

Arguments are used many times over: pass columns, not long expressions, and let a select
stand between steps. Quaternions are struct(w, x, y, z); vectors and matrices (row-major) are arrays of doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veldt.functions.elementwise import array_norm, dot, let


def quaternion(w, x, y, z) -> Column:
    return F.struct(*[(c if isinstance(c, Column) else F.lit(float(c))).cast("double").alias(n) for n, c in zip("wxyz", (w, x, y, z))])


def q_mul(a: Column, b: Column) -> Column:
    return quaternion(
        a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"], a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["w"] * b["y"] + a["y"] * b["w"] + a["z"] * b["x"] - a["x"] * b["z"], a["w"] * b["z"] + a["z"] * b["w"] + a["x"] * b["y"] - a["y"] * b["x"],
    )


def q_conj(q: Column) -> Column:
    return quaternion(q["w"], -q["x"], -q["y"], -q["z"])


def q_dot(a: Column, b: Column) -> Column:
    return a["w"] * b["w"] + a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def q_scale(q: Column, s: Column) -> Column:
    return quaternion(*(q[n] * s for n in "wxyz"))


def q_normalized(q: Column) -> Column:
    n = F.sqrt(q_dot(q, q))
    return q_scale(q, F.when(n > 0, 1 / F.when(n > 0, n).otherwise(1.0)).otherwise(F.lit(1.0)))


def q_inverse(q: Column) -> Column:
    """Conjugate over squared norm; zero for zero."""
    n = q_dot(q, q)
    return q_scale(q_conj(q), F.when(n > 0, 1 / F.when(n > 0, n).otherwise(1.0)).otherwise(F.lit(0.0)))


def q_matrix(q: Column) -> Column:
    """The rotation matrix of a unit quaternion, row-major."""
    w, x, y, z = (q[n] for n in "wxyz")
    return F.array(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))


def q_rotate(q: Column, p: Column) -> Column:
    return mat_vec(q_matrix(q), p, 3)


def q_angular_distance(a: Column, b: Column) -> Column:
    d = q_mul(a, q_conj(b))
    return 2 * F.atan2(F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]), F.abs(d["w"]))


def q_slerp(a: Column, b: Column, t: Column) -> Column:
    c = q_dot(a, b)
    size = F.least(F.abs(c), F.lit(1.0))
    theta = F.acos(size)
    s = F.sin(theta)
    near = size >= 1 - 2.220446049250313e-16
    safe = F.when(near, F.lit(1.0)).otherwise(s)
    p = F.when(near, 1 - t).otherwise(F.sin((1 - t) * theta) / safe)
    r = F.when(near, t).otherwise(F.sin(t * theta) / safe) * F.when(c < 0, -1.0).otherwise(1.0)
    return quaternion(*(p * a[n] + r * b[n] for n in "wxyz"))


def q_from_axis_angle(axis: Column, angle: Column) -> Column:
    s = F.sin(angle / 2)
    return quaternion(F.cos(angle / 2), *(axis[k] * s for k in range(3)))


def q_from_scaled_axis(r: Column) -> Column:
    n = array_norm(r)
    k = F.when(n > 0, F.sin(n / 2) / F.when(n > 0, n).otherwise(1.0)).otherwise(F.lit(0.5))
    return quaternion(F.cos(n / 2), *(r[c] * k for c in range(3)))


def q_to_scaled_axis(q: Column) -> Column:
    n = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
    angle = 2 * F.atan2(n, F.abs(q["w"])) * F.when(q["w"] < 0, -1.0).otherwise(1.0)
    k = F.when(n > 0, angle / F.when(n > 0, n).otherwise(1.0)).otherwise(F.lit(2.0))
    return F.array(*(q[c] * k for c in "xyz"))


def q_from_two_vectors(a: Column, b: Column) -> Column:
    """The shortest rotation from a to b (not opposite)."""
    na, nb = array_norm(a), array_norm(b)
    c = cross(a, b)
    return q_normalized(quaternion(na * nb + dot(a, b), *(c[k] for k in range(3))))


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def skew_symmetric(a: Column) -> Column:
    """The 3 x 3 matrix m (row-major) with m b = a x b."""
    zero = F.lit(0.0)
    return F.array(zero, -a[2], a[1], a[2], zero, -a[0], -a[1], a[0], zero)


def skew_vector(m: Column) -> Column:
    """The vector of a skew-symmetric 3 x 3 matrix."""
    return F.array(m[7], m[2], m[3])


def skew_exp(a: Column) -> Column:
    """exp of the skew-symmetric matrix of a: the rotation about a by its length (Rodrigues' formula)."""
    return q_matrix(q_from_scaled_axis(a))


def unit_orthogonal(a: Column) -> Column:
    """A unit vector orthogonal to a 3-vector."""
    flat = F.hypot(a[0], a[1])
    steep = F.hypot(a[1], a[2])
    use = (F.abs(a[0]) > 1e-12 * F.abs(a[2])) | (F.abs(a[1]) > 1e-12 * F.abs(a[2]))
    safe = F.when(use, flat).otherwise(F.when(steep > 0, steep).otherwise(1.0))
    return F.when(use, F.array(-a[1] / safe, a[0] / safe, F.lit(0.0))).otherwise(F.array(F.lit(0.0), -a[2] / safe, a[1] / safe))


def mat_vec(m: Column, x: Column, n: int) -> Column:
    return F.array(*[sum((m[r * n + c] * x[c] for c in range(1, n)), m[r * n] * x[0]) for r in range(n)])


def mat_mul(a: Column, b: Column, n: int) -> Column:
    return F.array(*[sum((a[r * n + k] * b[k * n + c] for k in range(1, n)), a[r * n] * b[c]) for r in range(n) for c in range(n)])


def det2(m: Column) -> Column:
    return m[0] * m[3] - m[1] * m[2]


def det3(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse3(m: Column) -> Column:
    """The inverse of a 3x3 matrix; null where it is singular."""
    d = det3(m)
    co = [m[(r + 1) % 3 * 3 + (c + 1) % 3] * m[(r + 2) % 3 * 3 + (c + 2) % 3] - m[(r + 1) % 3 * 3 + (c + 2) % 3] * m[(r + 2) % 3 * 3 + (c + 1) % 3] for c in range(3) for r in range(3)]
    return F.when(d != 0, F.array(*[x / F.when(d != 0, d).otherwise(1.0) for x in co]))


def rotation2(angle: Column) -> Column:
    return F.array(F.cos(angle), -F.sin(angle), F.sin(angle), F.cos(angle))


def euler_angles(m: Column) -> Column:
    """(z, y, x) angles of a rotation matrix m = Rz * Ry * Rx."""
    y = F.atan2(-m[6], F.hypot(m[0], m[3]))
    return F.array(F.atan2(m[3], m[0]), y, F.atan2(m[7], m[8]))


def from_euler(z: Column, y: Column, x: Column) -> Column:
    """Rz * Ry * Rx in closed form, row-major."""
    sz, cz, sy, cy, sx, cx = F.sin(z), F.cos(z), F.sin(y), F.cos(y), F.sin(x), F.cos(x)
    return F.array(cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx, sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx, -sy, cy * sx, cy * cx)


def axis_rotation(axis: int, angle: Column) -> Column:
    """The rotation about a coordinate axis, row-major."""
    c, s, zero, one = F.cos(angle), F.sin(angle), F.lit(0.0), F.lit(1.0)
    b, d = (axis + 1) % 3, (axis + 2) % 3
    cells = [zero] * 9
    cells[axis * 4], cells[b * 4], cells[d * 4], cells[b * 3 + d], cells[d * 3 + b] = one, c, c, -s, s
    return F.array(*cells)


def euler_sequence(m: Column, a0: int, a1: int, a2: int) -> Column:
    """Angles (x, y, z) with m = R(a0, x) R(a1, y) R(a2, z), for any sequence of axes in which neighbours differ."""
    return let(m, lambda m: _euler(m, a0, a1, a2))


def _euler(m: Column, a0: int, a1: int, a2: int) -> Column:
    """The middle angle is in [-pi/2, pi/2] for three different axes, in [0, pi] where a0 = a2."""
    at = lambda r, c: m[r * 3 + c]
    odd = 1.0 if (a0 + 1) % 3 == a1 else -1.0
    if a0 == a2:
        other = 3 - a0 - a1
        y = F.atan2(F.hypot(at(a0, a1), at(a0, other)), at(a0, a0))
        x = F.atan2(at(a1, a0), -odd * at(other, a0))
        z = F.atan2(at(a0, a1), odd * at(a0, other))
        return F.array(x, y, z)
    x = F.atan2(-odd * at(a1, a2), at(a2, a2))
    y = F.atan2(odd * at(a0, a2), F.hypot(at(a0, a0), at(a0, a1)))
    z = F.atan2(-odd * at(a0, a1), at(a0, a0))
    return F.array(x, y, z)


def angle_axis(m: Column) -> Column:
    """struct(angle, axis) of a rotation matrix, the angle in [0, pi]; no turn has the x axis."""
    return let(m, _angle_axis)


def _angle_axis(m: Column) -> Column:
    w = F.array(m[7] - m[5], m[2] - m[6], m[3] - m[1])
    size = array_norm(w)
    angle = F.atan2(size / 2, (m[0] + m[4] + m[8] - 1) / 2)
    # near a half turn the axis comes from the largest column of m + I
    columns = [F.array(m[k] + (1.0 if k == 0 else 0.0), m[3 + k] + (1.0 if k == 1 else 0.0), m[6 + k] + (1.0 if k == 2 else 0.0)) for k in range(3)]
    best = F.when((m[0] >= m[4]) & (m[0] >= m[8]), columns[0]).when(m[4] >= m[8], columns[1]).otherwise(columns[2])
    unit = lambda a: F.transform(a, lambda x: x / F.when(array_norm(a) > 0, array_norm(a)).otherwise(1.0))
    axis = F.when(size > 1e-7, unit(w)).when(angle > 1, unit(best)).otherwise(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    return F.struct(angle.alias("angle"), axis.alias("axis"))


def rotation2_angle(m: Column) -> Column:
    return F.atan2(m[2], m[0])


def rotation2_slerp(a: Column, b: Column, t: Column) -> Column:
    """The angle between two angles, on the shorter way."""
    turn = b - a
    return a + t * F.atan2(F.sin(turn), F.cos(turn))


def homogeneous(a: Column) -> Column:
    return F.concat(a, F.array(F.lit(1.0)))


def hnormalized(a: Column) -> Column:
    return let(a, lambda a: F.transform(F.slice(a, 1, F.size(a) - 1), lambda x: x / F.element_at(a, -1)))


def affine(linear: Column, translation: Column, n: int) -> Column:
    """The (n+1) x (n+1) matrix of x -> linear x + translation."""
    cells = []
    for r in range(n):
        cells += [linear[r * n + c] for c in range(n)] + [translation[r]]
    return F.array(*cells, *[F.lit(0.0)] * n, F.lit(1.0))


def transform_point(m: Column, p: Column, n: int) -> Column:
    return hnormalized(let(m, lambda m: let(homogeneous(p), lambda h: mat_vec(m, h, n + 1))))


def translation(t: Column, n: int) -> Column:
    return affine(F.array(*[F.lit(1.0 if r == c else 0.0) for r in range(n) for c in range(n)]), t, n)


def scaling(f: Column, n: int) -> Column:
    """By factors along the axes."""
    return affine(F.array(*[f[r] if r == c else F.lit(0.0) for r in range(n) for c in range(n)]), F.array(*[F.lit(0.0)] * n), n)


def linear_part(m: Column, n: int) -> Column:
    return F.array(*[m[r * (n + 1) + c] for r in range(n) for c in range(n)])


def translation_part(m: Column, n: int) -> Column:
    return F.array(*[m[r * (n + 1) + n] for r in range(n)])


def transform_product(a: Column, b: Column, n: int) -> Column:
    return let(a, lambda a: let(b, lambda b: mat_mul(a, b, n + 1)))


def isometry_inverse(m: Column, n: int) -> Column:
    """The inverse of a rotation with a shift: the turn transposed."""

    def inverse(m: Column) -> Column:
        turned = F.array(*[m[c * (n + 1) + r] for r in range(n) for c in range(n)])
        shift = translation_part(m, n)
        back = F.array(*[-sum((m[k * (n + 1) + r] * shift[k] for k in range(1, n)), m[r] * shift[0]) for r in range(n)])
        return affine(turned, back, n)

    return let(m, inverse)


def affine_inverse3(m: Column) -> Column:
    """The inverse of a 3-D affine map; null where its linear part is singular."""

    def inverse(m: Column) -> Column:
        back = lambda w: F.transform(mat_vec(w, translation_part(m, 3), 3), lambda x: -x)
        return let(let(linear_part(m, 3), inverse3), lambda w: F.when(w.isNotNull(), affine(w, back(w), 3)))

    return let(m, inverse)


def plane_signed_distance(normal: Column, offset: Column, p: Column) -> Column:
    return dot(normal, p) + offset


def plane_projection(normal: Column, offset: Column, p: Column) -> Column:
    s = plane_signed_distance(normal, offset, p)
    return F.zip_with(p, normal, lambda x, n: x - s * n)


def line_projection(origin: Column, direction: Column, p: Column) -> Column:
    t = dot(direction, F.zip_with(p, origin, lambda x, o: x - o))
    return F.zip_with(origin, direction, lambda o, u: o + t * u)


def line_distance(origin: Column, direction: Column, p: Column) -> Column:
    return array_norm(F.zip_with(p, line_projection(origin, direction, p), lambda x, y: x - y))


def line_plane_intersection(origin: Column, direction: Column, normal: Column, offset: Column) -> Column:
    """The point where a line meets a plane; null for a parallel one."""
    under = dot(normal, direction)
    t = -(offset + dot(normal, origin)) / F.when(under != 0, under)
    return F.when(under != 0, F.zip_with(origin, direction, lambda o, u: o + t * u))


def _all(a: Column) -> Column:
    return F.forall(a, lambda x: x)


def box_contains(low: Column, high: Column, p: Column) -> Column:
    return _all(F.zip_with(low, p, lambda a, b: a <= b)) & _all(F.zip_with(p, high, lambda a, b: a <= b))


def box_intersects(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    return _all(F.zip_with(low1, high2, lambda a, b: a <= b)) & _all(F.zip_with(low2, high1, lambda a, b: a <= b))


def box_intersection(low1: Column, high1: Column, low2: Column, high2: Column) -> tuple[Column, Column]:
    return F.zip_with(low1, low2, lambda a, b: F.greatest(a, b)), F.zip_with(high1, high2, lambda a, b: F.least(a, b))


def box_merged(low1: Column, high1: Column, low2: Column, high2: Column) -> tuple[Column, Column]:
    return F.zip_with(low1, low2, lambda a, b: F.least(a, b)), F.zip_with(high1, high2, lambda a, b: F.greatest(a, b))


def box_volume(low: Column, high: Column) -> Column:
    """0 for an empty box."""
    return F.aggregate(F.zip_with(low, high, lambda a, b: F.greatest(b - a, F.lit(0.0))), F.lit(1.0), lambda s, x: s * x)


def box_center(low: Column, high: Column) -> Column:
    return F.zip_with(low, high, lambda a, b: (a + b) / 2)


def box_exterior_distance(low: Column, high: Column, p: Column) -> Column:
    below = F.zip_with(low, p, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    above = F.zip_with(p, high, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    return array_norm(F.zip_with(below, above, lambda a, b: a + b))


def box_sizes(low: Column, high: Column) -> Column:
    return F.zip_with(low, high, lambda a, b: b - a)


def box_diagonal(low: Column, high: Column) -> Column:
    return array_norm(box_sizes(low, high))


def box_is_empty(low: Column, high: Column) -> Column:
    return F.exists(F.zip_with(low, high, lambda a, b: a > b), lambda x: x)


def box_extended(low: Column, high: Column, p: Column) -> tuple[Column, Column]:
    return F.zip_with(low, p, lambda a, b: F.least(a, b)), F.zip_with(high, p, lambda a, b: F.greatest(a, b))


def box_clamped(low: Column, high: Column, p: Column) -> Column:
    """The point of the box that is nearest to p."""
    return F.zip_with(F.zip_with(p, low, lambda a, b: F.greatest(a, b)), high, lambda a, b: F.least(a, b))


def box_corner(low: Column, high: Column, k: int, n: int) -> Column:
    """Corner k: bit d of k says whether dimension d is at its high end."""
    return F.array(*[(high if k >> c & 1 else low)[c] for c in range(n)])


def plane_through(p: Column, q: Column, r: Column) -> Column:
    """struct(normal, offset) of the plane through three points in space."""
    to = lambda a, b: F.zip_with(b, a, lambda x, y: x - y)
    n = cross(to(p, q), to(p, r))
    unit = F.transform(n, lambda x: x / array_norm(n))
    return F.struct(unit.alias("normal"), (-dot(unit, p)).alias("offset"))
