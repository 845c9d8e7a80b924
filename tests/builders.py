"""Captures made of bytes, for tests."""

import struct


def pcap(frames, link=1, order="<", nano=False):
    magic = {("<", False): b"\xd4\xc3\xb2\xa1", (">", False): b"\xa1\xb2\xc3\xd4", ("<", True): b"\x4d\x3c\xb2\xa1", (">", True): b"\xa1\xb2\x3c\x4d"}
    out = magic[order, nano] + struct.pack(order + "2HiIII", 2, 4, 0, 0, 65535, link)
    for us, data in frames:
        out += struct.pack(order + "4I", us // 1_000_000, us % 1_000_000 * (1000 if nano else 1), len(data), len(data)) + data
    return out


def pcapng(frames, ticks_exponent=9, order="<"):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        size = len(body) + 12
        return struct.pack(order + "2I", kind, size) + body + struct.pack(order + "I", size)

    magic = b"\x4d\x3c\x2b\x1a" if order == "<" else b"\x1a\x2b\x3c\x4d"
    out = block(0x0A0D0D0A, magic + struct.pack(order + "2Hq", 1, 0, -1))
    for _ in range(2):
        out += block(1, struct.pack(order + "2HI", 1, 0, 65535) + struct.pack(order + "2HB3x", 9, 1, ticks_exponent) + struct.pack(order + "2H", 0, 0))
    for interface, us, data in frames:
        ticks = us * 10**ticks_exponent // 1_000_000
        out += block(6, struct.pack(order + "5I", interface, ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data)
    return out


def udp(payload, src="192.0.2.1", dst="198.51.100.1", sport=5004, dport=40000, vlan=False):
    address = lambda a: bytes(map(int, a.split(".")))
    segment = struct.pack(">4H", sport, dport, 8 + len(payload), 0) + payload
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(segment), 0, 0, 64, 17, 0) + address(src) + address(dst)
    return b"\0" * 12 + (b"\x81\x00\x00\x05" if vlan else b"") + b"\x08\x00" + ip + segment


def rtp(seq, ts, payload, ssrc=42, pt=96, marker=False):
    return struct.pack(">BBHII", 0x80, (0x80 if marker else 0) | pt, seq & 0xFFFF, ts, ssrc) + payload


def sip(start, call="c1", from_tag="a", to_tag=None, branch="z9hG4bK1", cseq="1 INVITE", body=""):
    to = ";tag=" + to_tag if to_tag else ""
    lines = [start, f"Via: SIP/2.0/UDP h;branch={branch}", f"From: <sip:a@h>;tag={from_tag}", f"To: <sip:b@h>{to}", f"Call-ID: {call}", f"CSeq: {cseq}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + body).encode()


def ethernet(transport, number, src, dst):
    address = lambda a: bytes(map(int, a.split(".")))
    return b"\0" * 12 + b"\x08\x00" + struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(transport), 0, 0, 64, number, 0) + address(src) + address(dst) + transport


def tcp_frame(data, seq, src, sport, dst, dport, flags=0x10):
    return ethernet(struct.pack(">HHIIBBHHH", sport, dport, seq % (1 << 32), 0, 0x50, flags, 65535, 0, 0) + data, 6, src, dst)


def rtsp_dialog(us, exchanges, client=("198.51.100.1", 41000), server=("192.0.2.1", 554)):
    """Frames of a control connection: requests and responses in turn."""
    frames, sent = [], {0: 1, 1: 1}
    for i, text in enumerate(exchanges):
        side = i % 2
        ends = (*client, *server) if side == 0 else (*server, *client)
        frames.append((us + i * 1000, tcp_frame(text.encode(), sent[side], *ends)))
        sent[side] += len(text)
    return frames


def bit_bytes(bits):
    bits += "1"
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def ue(n):
    code = format(n + 1, "b")
    return "0" * (len(code) - 1) + code


def h264_sets(width, height, level=30, references=1, number=0):
    """Sequence and picture parameters of a picture of whole macroblocks."""
    sps = format(66, "08b") + "0" * 8 + format(level, "08b") + ue(number) + ue(0) + ue(2) + ue(references) + "0" + ue(width // 16 - 1) + ue(height // 16 - 1) + "11" + "0" + "0"
    pps = ue(0) + ue(number) + "00" + ue(0) + ue(0) + ue(0) + "000" + ue(0) + ue(0) + ue(0) + "100"
    return b"\x67" + bit_bytes(sps), b"\x68" + bit_bytes(pps)


def h265_sets(width, height, level=93, pictures=1):
    head = "0000" + "000" + "1" + format(1, "08b") + "0" * 80 + format(level, "08b")
    sps = head + ue(0) + ue(1) + ue(width) + ue(height) + "0" + ue(0) + ue(0) + ue(4) + "1" + ue(pictures - 1) + ue(0) + ue(0)
    return b"\x40\x01\x0c", b"\x42\x01" + bit_bytes(sps), b"\x44\x01" + bit_bytes(ue(0) + ue(0))
