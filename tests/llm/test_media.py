import hashlib
import io
import struct
import wave
import zlib
import zipfile

from mathquarry.llm import media


def png():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def samples():
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + b"\0" * 6 + b"\x2c" + b"\0" * 4 + b"\x01\0\x01\0\0" + b"\x02\x02\x44\x01\x00" + b"\x3b"
    bmp = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 28
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02\x12\xff\x00\x34\xff\xd9"
    midi = b"MThd\0\0\0\x06\0\0\0\x01\0\x60MTrk\0\0\0\x04\0\xff\x2f\0"
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a", "b" * 50)
    mp4 = struct.pack(">I4s8s", 16, b"ftyp", b"isom\0\0\0\0") + struct.pack(">I4s", 8, b"moov")
    ogg = b"OggS\0\x04" + b"\0" * 20 + b"\x01\x05hello"
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n0\n%%EOF"
    return {"image/png": png(), "image/gif": gif, "image/bmp": bmp, "image/jpeg": jpeg, "audio/midi": midi, "application/zip": box.getvalue(), "video/mp4": mp4, "audio/ogg": ogg, "application/pdf": pdf, "audio/wav": media.as_wav(b"abc")}


def test_each_format_is_confirmed_carved_and_refused_when_cut():
    sniffer = media.Sniffer()
    for kind, data in samples().items():
        assert sniffer(data) == [(0, len(data), kind)], kind
        assert sniffer(b"some text BM GIF89a " + data + b" tail") == [(20, len(data), kind)], kind
        assert sniffer(data[:-3]) == [], kind
    assert sniffer(b"GIF87a is a name, BM too, %PDF- and RIFF, PK\x03\x04 ID3 fLaC OggS MThd ftyp") == []


def test_sniff_column(spark):
    rows = [(1, png(), "image/gif", "x"), (2, b"text" + png(), "text/plain", None), (3, None, None, None), (4, b"", "image/png", ""), (5, media.as_wav(media.padded(b"q" + png())), "audio/wav", "")]
    got = {r.id: r.media_info for r in media.sniff_media(spark.createDataFrame(rows, "id int, b binary, d string, media_info string"), "b", "d").collect()}
    assert (got[1].type, got[1].corrected, got[1].length) == ("image/png", True, len(png()))
    assert [(e.at, e.type, bytes(e.data)) for e in got[2].embedded] == [(4, "image/png", png())]
    assert got[3].type is None and got[4].type is None and not got[4].embedded
    assert (got[5].type, got[5].corrected, [(e.at, e.type) for e in got[5].embedded]) == ("audio/wav", False, [(45, "image/png")])
    twice = spark.createDataFrame([(1, png(), "image/png", "x")] * 2, "id int, b binary, d string, media_info string")
    assert media.sniff_media(twice, "b", "d").count() == 2 and media.sniff_media(twice.limit(0), "b", "d").count() == 0


def mp3(frames=3):
    return b"ID3\x04\0\0\0\0\0\x05hello" + (b"\xff\xfb\x90\x00" + b"\0" * 413) * frames


def flac(frames=3, total=True):
    """Frames of constant subframes: 16 bits, one channel, 192 samples each."""
    out = b""
    for k in range(frames):
        head = b"\xff\xf8\x19\x08" + bytes([k])
        crc = 0
        for x in head:
            crc = media._CRC8[crc ^ x]
        body = head + bytes([crc]) + b"\0\x12" + bytes([k * 7 % 256])
        crc = 0
        for x in body:
            crc = (crc << 8 & 0xFFFF) ^ media._CRC16[crc >> 8 ^ x]
        out += body + crc.to_bytes(2, "big")
    info = struct.pack(">HH", 192, 192) + b"\0" * 6 + ((44100 << 44) | (15 << 36) | (192 * frames if total else 0)).to_bytes(8, "big") + b"\0" * 16
    return b"fLaC\x80\0\0\x22" + info + out


def test_frames_tell_where_audio_ends():
    sniffer = media.Sniffer()
    assert media._CRC8[1] == 0x07 and media._CRC16[1] == 0x8005
    for sound, kind in ((mp3(), "audio/mpeg"), (mp3() + b"TAG" + b"t" * 125, "audio/mpeg"), (flac(), "audio/flac"), (flac(total=False), "audio/flac")):
        assert sniffer(sound) == [(0, len(sound), kind)]
        if b"TAG" in sound or kind == "audio/mpeg" or sound == flac():
            assert sniffer(b"x" + sound + b"yy" + png()) == [(1, len(sound), kind), (len(sound) + 3, len(png()), "image/png")]
    assert sniffer(mp3(0)) == [] and sniffer(flac(0))[0][2] == "audio/flac"


def test_media_in_stored_members_and_documents():
    box, inner = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.gif", samples()["image/gif"])
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a.png", png())
        z.writestr("b.png", png(), compress_type=zipfile.ZIP_DEFLATED)
        z.writestr("c.zip", inner.getvalue())
    data = b"lead " + box.getvalue()
    found = media.Sniffer()(data)
    assert [k for _, _, k in found] == ["application/zip", "image/png", "application/zip", "image/gif"]
    assert all(data[a : a + n] in (box.getvalue(), png(), inner.getvalue(), samples()["image/gif"]) for a, n, _ in found)
    pdf = b"%PDF-1.4\n1 0 obj\nstream\n" + samples()["image/jpeg"] + b"\nendstream\nstartxref\n0\n%%EOF"
    assert [k for _, _, k in media.Sniffer()(pdf)] == ["application/pdf", "image/jpeg"]


def test_features_come_from_what_was_stored(spark):
    texts = ["", None, "é" * 288, "x" * 577, "x" * 577, "long " * 30000]
    docs = spark.createDataFrame([(i if i else None, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = {r.doc_id or 0: r for r in media.media_features(docs).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        file = io.BytesIO()
        with wave.open(file, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(payload)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(file.getvalue()), hashlib.sha256(file.getvalue()).hexdigest())
        assert r.feature.startswith("audio/wav;rate=8000;")
    assert got[3].feature == got[4].feature
    assert media.media_features(docs.limit(0)).count() == 0
